"""Deterministic event, covariate, polygon and draw tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.config import Domain

E_DOMAIN = Domain(t_max=30.0)
O_DOMAIN = Domain(t_max=2405.0)
#: Three disjoint polygons.
POLYGONS = (
    (0, ((0.1, 0.1), (0.6, 0.15), (0.3, 0.7))),
    (1, ((0.55, 0.5), (0.95, 0.55), (0.9, 0.95), (0.6, 0.9))),
    (2, ((0.65, 0.05), (0.95, 0.05), (0.95, 0.4), (0.85, 0.4), (0.85, 0.2), (0.65, 0.2))),
)


def _spread(key: str, by: int, modulus: int, other: str, by2: int, modulus2: int) -> Column:
    fine = (F.col(other) * by2) % modulus2 / F.lit(float(modulus2))
    return ((F.col(key) * by) % modulus + fine) / F.lit(float(modulus))


def events_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-day events clustered by user: point_id, ts, X, Y, T."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(86_400_000_000.0)
    return df.select(
        F.col("event_id").alias("point_id"), "ts", _spread("user_id", 37, 101, "event_id", 7919, 1009).alias("X"), _spread("user_id", 53, 103, "event_id", 104729, 1013).alias("Y"), t.alias("T")
    )


def events_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-year events of whole days: point_id, X, Y, T."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    t = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double")
    return df.select(
        F.col("o_orderkey").alias("point_id"), _spread("o_custkey", 37, 101, "o_orderkey", 7919, 1009).alias("X"), _spread("o_custkey", 53, 103, "o_orderkey", 104729, 1013).alias("Y"), t.alias("T")
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_e(spark, sf_dir)
    x = F.when(F.col("point_id") % 97 == 0, "bad").otherwise(F.col("X").cast("string"))
    t = F.when(F.col("point_id") % 89 != 0, F.col("T").cast("string"))
    return e.select("point_id", x.alias("X"), F.col("Y").cast("string").alias("Y"), t.alias("T"), F.lit(1).alias("day"))


def season_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = events_o(spark, sf_dir)
    return o.withColumn("A", F.pmod("T", F.lit(365.0)) + F.when(F.col("point_id") % 50 == 0, 100.0).otherwise(0.0))


def covariates(spark: SparkSession) -> DataFrame:
    """A hundred cells of size 0.1: cov_id, bounds, c1, c2, c3."""
    i = F.col("id")
    part = lambda k, m: ((i * k) % m) / F.lit(float(m))
    low_x, low_y = (i % 10) / F.lit(10.0), F.floor(i / 10) / F.lit(10.0)
    return spark.range(100).select(
        i.alias("cov_id"), low_x.alias("x_min"), (low_x + 0.1).alias("x_max"), low_y.alias("y_min"), (low_y + 0.1).alias("y_max"),
        part(37, 101).alias("c1"), part(53, 103).alias("c2"), part(29, 107).alias("c3"),
    )


def polygons(spark: SparkSession) -> DataFrame:
    rows = [(k, [{"x": x, "y": y} for x, y in ring]) for k, ring in POLYGONS]
    return spark.createDataFrame(rows, "poly_id int, ring array<struct<x:double,y:double>>")


def draws(spark: SparkSession, n: int = 200) -> DataFrame:
    """Parameter draws: draw_id, a_0, alpha, beta, gamma, sigmax_2, w1, w2, w3."""
    i = F.col("id")
    part = lambda k, m, scale: ((i * k) % m) / F.lit(scale)
    weight = lambda k: part(k, 239, 239.0) - 0.5
    return spark.range(n).select(
        i.alias("draw_id"), (2 + part(41, 229, 229.0)).alias("a_0"), (0.1 + part(37, 211, 1055.0)).alias("alpha"), (0.02 + part(53, 223, 2230.0)).alias("beta"),
        (0.5 + part(31, 233, 233.0)).alias("gamma"), (0.005 + part(29, 227, 22700.0)).alias("sigmax_2"), weight(17).alias("w1"), weight(43).alias("w2"), weight(61).alias("w3"),
    )


def fields(spark: SparkSession, n: int = 200) -> DataFrame:
    """Latent fields in long form: draw_id, field, idx, value."""
    def one(name: str, size: int, k: int, m: int) -> DataFrame:
        both = spark.range(n * size).select((F.floor(F.col("id") / size)).alias("draw_id"), F.lit(name).alias("field"), (F.col("id") % size).alias("idx"))
        return both.withColumn("value", ((F.col("draw_id") * 7 + F.col("idx") * k) % m) / F.lit(float(m)) - 0.5)

    return one("f_t", 50, 13, 53).union(one("f_a", 24, 11, 29)).union(one("f_xy", 625, 17, 641))


def load_bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A named bundle: events, covariates and boundary."""
    return {"events": events_e(spark, sf_dir), "covariates": covariates(spark), "boundary": polygons(spark)}
