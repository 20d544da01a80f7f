"""Pairs of an event and an earlier one that may have triggered it: band self-joins by buckets.

A bucket is as wide as the window, so an event's earlier partners are in its own bucket or the one
before; the earlier side is sent to both and the join is an equi-join, with the exact band as residual.
A radius adds space buckets of its width, nine for the earlier side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.operators.ranks import _met, quantiles

#: Pair joins above this bound are refused.
MOST_PAIRS = 4_000_000_000


def _offsets(*steps: int) -> Column:
    return F.explode(F.array(*[F.lit(k) for k in steps]))


def event_pairs(ev: DataFrame, window: float, radius: float | None = None, key: str = "point_id", t: str = "u", x: str = "sx", y: str = "sy") -> DataFrame:
    """i (later), j (earlier), dt, dx, dy with 0 < dt <= window and, if given, distance <= radius."""
    base = ev.select(F.col(key).alias("id"), F.col(t).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))
    # Both sides read one exchange of the bare events: few input files would else make all copies in as few tasks.
    base = base.repartition(int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    b = F.floor(F.col("t") / window)
    later = base.select(F.col("id").alias("i"), F.col("t").alias("ti"), F.col("x").alias("xi"), F.col("y").alias("yi"), b.alias("b"))
    earlier = base.select(F.col("id").alias("j"), F.col("t").alias("tj"), F.col("x").alias("xj"), F.col("y").alias("yj"), b.alias("b0"), _offsets(0, 1).alias("o"))
    earlier = earlier.withColumn("b", F.col("b0") + F.col("o")).drop("b0", "o")
    keys = ["b"]
    if radius is not None:
        keys += ["gx", "gy"]
        later = later.withColumns({"gx": F.floor(F.col("xi") / radius), "gy": F.floor(F.col("yi") / radius)})
        earlier = earlier.select("*", _offsets(-1, 0, 1).alias("ox")).select("*", _offsets(-1, 0, 1).alias("oy"))
        earlier = earlier.withColumns({"gx": F.floor(F.col("xj") / radius) + F.col("ox"), "gy": F.floor(F.col("yj") / radius) + F.col("oy")}).drop("ox", "oy")
    dt, dx, dy = F.col("ti") - F.col("tj"), F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")
    hit = (dt > 0) & (dt <= window)
    if radius is not None:
        hit &= F.sqrt(dx * dx + dy * dy) <= radius
    # Sizes are estimated before the copies are made, so a broadcast of them would be chosen by mistake.
    return later.join(earlier.hint("merge"), keys).filter(hit).select("i", "j", dt.alias("dt"), dx.alias("dx"), dy.alias("dy"))


def lag_pairs(df: DataFrame, col: str, window: float, subset: DataFrame | None = None, key: str = "point_id") -> DataFrame:
    """i, j, dt of one column; `subset` (keys) limits the later rows."""
    b = F.floor(F.col(col) / window)
    later = df.select(F.col(key).alias("i"), F.col(col).alias("ti"), b.alias("b"))
    if subset is not None:
        later = later.join(subset.select(F.col(key).alias("i")), "i", "left_semi")
    earlier = df.select(F.col(key).alias("j"), F.col(col).alias("tj"), b.alias("b0"), _offsets(0, 1).alias("o")).withColumn("b", F.col("b0") + F.col("o"))
    dt = F.col("ti") - F.col("tj")
    return later.join(earlier.drop("b0", "o").hint("merge"), "b").filter((dt > 0) & (dt <= window)).select("i", "j", dt.alias("dt"))


def pair_bound(ev: DataFrame, window: float, t: str = "u", radius: float | None = None, x: str = "sx", y: str = "sy") -> DataFrame:
    """An upper bound of the number of pairs, over the buckets of the join: n_b times the n of b and its earlier neighbours."""
    keys = ["b"] if radius is None else ["b", "gx", "gy"]
    space = [] if radius is None else [F.floor(F.col(x) / radius).alias("gx"), F.floor(F.col(y) / radius).alias("gy")]
    counts = ev.groupBy(F.floor(F.col(t) / window).alias("b"), *space).agg(F.count("*").alias("n"))
    if radius is not None:
        near = counts.select("*", _offsets(0, 1).alias("o")).select("*", _offsets(-1, 0, 1).alias("ox")).select("*", _offsets(-1, 0, 1).alias("oy"))
        near = near.select((F.col("b") + F.col("o")).alias("b"), (F.col("gx") + F.col("ox")).alias("gx"), (F.col("gy") + F.col("oy")).alias("gy"), "n")
        return counts.join(near.groupBy(*keys).agg(F.sum("n").alias("m")), keys).agg(F.sum(F.col("n") * F.col("m")).alias("pairs_at_most"))
    before = counts.select((F.col("b") + 1).alias("b"), F.col("n").alias("m"))
    return counts.join(before, "b", "left").agg(F.sum(F.col("n") * (F.col("n") + F.coalesce("m", F.lit(0)))).alias("pairs_at_most"))


def checked_pairs(ev: DataFrame, window: float, radius: float | None = None, most: int = MOST_PAIRS) -> DataFrame:
    """event_pairs, refused when the bound is above `most`."""
    n = pair_bound(ev, window, radius=radius).first()[0] or 0
    if n > most:
        raise ValueError(f"up to {n} pairs; the limit is {most}: use a smaller window or a radius")
    return event_pairs(ev, window, radius)


def inter_arrival(df: DataFrame, by: str, t: str = "T", span: float = 1.0) -> DataFrame:
    """Waiting times between neighbouring events of each group: count, mean, median, 99th percentile.

    Events are ordered inside stretches of `span`; the first of a stretch waits since the last event of
    the stretch before, of which a group has one row each. Percentiles come from ranked waiting times, so
    no task orders all events of a group. A null group is a group.
    """
    rows = df.select(by, F.col(t).alias("t"), F.floor(F.col(t) / span).alias("b")).filter("t is not null")
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(by, "b").orderBy("t"))
    inner = rows.select(by, gap.alias("gap"))
    ends = rows.groupBy(by, "b").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    outer = ends.select(by, (F.col("first") - F.lag("last").over(Window.partitionBy(by).orderBy("b"))).alias("gap"))
    gaps = inner.unionByName(outer).filter("gap is not null")
    means = gaps.groupBy(by).agg(F.count("*").alias("n"), F.avg("gap").alias("mean"))
    return _met(means, quantiles(gaps, [by], "gap", {"median": 0.5, "p99": 0.99}), [by]).select(by, "n", "mean", "median", "p99")
