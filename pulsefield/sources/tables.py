"""Reading events, covariates and draws, and writing draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "X double, Y double, T double, A double"
RING = "array<struct<x:double,y:double>>"


def read_events(spark: SparkSession, source: str | DataFrame, fmt: str = "parquet", columns: dict[str, str] | None = None, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Events from a path (csv, parquet, json, orc) or a frame; `columns` renames {theirs: ours}."""
    if isinstance(source, DataFrame):
        df = source
    else:
        reader = spark.read.format(fmt)
        if fmt in ("csv", "json"):
            reader = reader.schema(schema).option("header", True)
        df = reader.load(source)
    return df.withColumnsRenamed(columns or {})


def read_covariates(spark: SparkSession, source: str | DataFrame, cell_size: tuple[float, float] | None = None, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Polygons with covariates: centres X, Y with a cell size, or rows that hold a `ring`.

    A ring given as text is GeoJSON, a Polygon or a MultiPolygon, with its holes: all its rings become
    one, which walks from the first ring's first corner to each further ring and back. Under the even-odd
    rule the walks cancel; holes are turned against their outer ring, so that areas subtract.
    """
    from pulsefield.operators.spatial import cells_from_centres

    if isinstance(source, DataFrame):
        df = source
    else:
        reader = spark.read.format(fmt)
        df = (reader.schema(schema) if schema else reader).option("header", True).load(source)
    if cell_size:
        return cells_from_centres(df, *cell_size)
    if df.schema["ring"].dataType.simpleString() == "string":
        one = F.from_json("ring", "coordinates array<array<array<double>>>")["coordinates"]
        many = F.from_json("ring", "coordinates array<array<array<array<double>>>>")["coordinates"]
        shapes = F.when(F.get_json_object("ring", "$.type") == "MultiPolygon", many).otherwise(F.array(one))
        df = df.withColumn("ring", _walk(shapes))
    return df


def _walk(shapes: Column) -> Column:
    """One ring through all rings of all polygons (outer ring first, then holes)."""
    xy = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    def turned(ring: Column, k: Column) -> Column:
        cross = F.transform(ring, lambda p, i: p["x"] * F.element_at(ring, F.pmod(i + 1, F.size(ring)) + 1)["y"] - F.element_at(ring, F.pmod(i + 1, F.size(ring)) + 1)["x"] * p["y"])
        area = F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)
        return F.when((area < 0) == (k == 0), F.reverse(ring)).otherwise(ring)

    rings = F.flatten(F.transform(shapes, lambda rs: F.transform(rs, lambda r, k: turned(xy(r), k))))
    start = F.slice(rings[0], F.lit(1), F.lit(1))
    joined = F.flatten(F.transform(rings, lambda r: F.concat(r, F.slice(r, F.lit(1), F.lit(1)), start)))
    return F.when(F.size(rings) == 1, rings[0]).otherwise(joined)


def write_draws(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
