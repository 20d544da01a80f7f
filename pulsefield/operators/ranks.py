"""Exact ranks, quantiles and intervals of values by key, without ordering a key's values in one task.

Equal values are counted first. A sample of a key's distinct values, picked by their hashes and so the same
whenever it is computed, gives splitters; the buckets between them hold about equal numbers of distinct
values however the values are spread. A value's rank is the count of the buckets before its own plus its
rank inside. Nulls are set apart: they are not counted and have no rank. NaN is one value, above infinity. A
null key is a key of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values sampled for a key; of these every `EVERY`-th is a splitter; splitters in a run; ranks in a block of `hpdi`.
SAMPLE, EVERY, RUN, SPAN = 8192, 32, 16, 64


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys where null equals null; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(Column.__and__, (left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def _splitters(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, _coarse, _fine: the splitters in runs of `RUN`, and the first of each run."""
    h = F.xxhash64("v", F.lit("splitter"))
    slots = counts.groupBy(*keys, F.pmod(h, F.lit(SAMPLE)).alias("_slot")).agg(F.min_by("v", h).alias("s"))
    sample = slots.groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("s"))  # SAMPLE values at most
    some = F.filter("s", lambda _, i: i % EVERY == EVERY - 1)
    runs = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda k: F.slice(x, k * RUN + 1, F.lit(RUN)))
    return sample.select(*keys, some.alias("_s")).filter(F.size("_s") > 0).select(*keys, F.filter("_s", lambda _, i: i % RUN == 0).alias("_coarse"), runs(F.col("_s")).alias("_fine"))


def bucketed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys, v, c (rows with that value), bucket: buckets of a key are in order of v."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    placed = _met(counts, _splitters(counts, keys), keys, "left")
    upto = lambda a: F.size(F.filter(a, lambda s: s <= F.col("v")))
    run = upto(F.col("_coarse"))
    bucket = F.when(F.col("_coarse").isNull() | (run == 0), 0).otherwise((run - 1) * RUN + upto(F.get("_fine", run - 1)))
    return placed.select(*keys, "v", "c", bucket.cast("int").alias("bucket"))


def ranked_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys, v, first, last, n: the ranks (from 0) that each distinct value has among the n values of its key."""
    placed = bucketed(rows, keys, value)
    sums = placed.groupBy(*keys, "bucket").agg(F.sum("c").alias("_sum"))
    of_key = Window.partitionBy(*keys)  # a row per bucket
    before = F.coalesce(F.sum("_sum").over(of_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "bucket", before.alias("_before"), F.sum("_sum").over(of_key).alias("n"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = _met(placed.withColumn("_upto", F.sum("c").over(inside)), sums, [*keys, "bucket"])
    last = F.col("_before") + F.col("_upto") - 1
    return ranks.select(*keys, "v", (last - F.col("c") + 1).alias("first"), last.alias("last"), "n")


def interpolated(ranks: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """The keys and quantiles of ranked values: between the two values next to rank (n - 1) * share."""
    found = []
    for name, share in shares.items():
        at = (F.col("n") - 1) * F.lit(share)
        value = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))
        found += [value(F.floor(at)).alias(f"_low_{name}"), value(F.ceil(at)).alias(f"_high_{name}")]
    rows = ranks.groupBy(*keys, "n").agg(*found)

    def between(name: str, share: float) -> Column:
        low, high, at = F.col(f"_low_{name}"), F.col(f"_high_{name}"), (F.col("n") - 1) * F.lit(share)
        return F.when(low == high, low).otherwise(low + (at - F.floor(at)) * (high - low)).alias(name)

    return rows.select(*keys, *[between(c, share) for c, share in shares.items()])


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The keys and the exact quantiles of their values, linearly interpolated; a key of nulls alone has no row."""
    if not keys:
        return quantiles(rows.withColumn("_all", F.lit(0)), ["_all"], value, shares).drop("_all")
    return interpolated(ranked_values(rows, keys, value), keys, shares)


def hpdi(rows: DataFrame, keys: list[str], value: str = "value", prob: float = 0.9) -> DataFrame:
    """The keys, low, high: the shortest interval of sorted values that spans floor(prob * n) steps; the lowest on ties.

    An interval that starts in a run of equal values is shortest from the first of them. The value at its
    end is found by blocks of `SPAN` ranks. Nulls do not count; a key of nulls alone has no row.
    """
    ranks = ranked_values(rows, keys, value)
    steps = F.least(F.floor(F.col("n") * prob), F.col("n") - 1)
    starts = ranks.select(*keys, F.col("v").alias("low"), (F.col("first") + steps).alias("end"), "n").filter(F.col("end") < F.col("n"))
    starts = starts.withColumn("_block", F.floor(F.col("end") / SPAN))
    over = F.explode(F.sequence(F.floor(F.col("first") / SPAN), F.floor(F.col("last") / SPAN)))
    ends = ranks.select(*keys, F.col("v").alias("high"), "first", "last", over.alias("_block"))
    both = _met(starts, ends, [*keys, "_block"]).filter(F.col("end").between(F.col("first"), F.col("last")))
    width = F.when(F.col("high") == F.col("low"), F.lit(0.0)).otherwise(F.col("high") - F.col("low"))
    best = both.groupBy(*keys).agg(F.min(F.struct(width.alias("width"), "low", "high")).alias("b"))
    return best.select(*keys, F.col("b.low").alias("low"), F.col("b.high").alias("high"))
