"""Posterior by importance: reproducible draws from a stated proposal, Pareto-smoothed weights, bootstrap of summaries.

Random numbers are hashes of a seed, a counter and a name, so a draw is the same wherever and whenever it is
computed, whatever the partitioning, and SQL can repeat it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.operators.ranks import quantiles


def uniform(counter: Column, name: str, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of `seed:counter:name`."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), counter.cast("string"), F.lit(name)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def standard_normal(counter: Column, name: str, seed: int) -> Column:
    return F.sqrt(-2 * F.log(uniform(counter, name + "/1", seed))) * F.cos(2 * math.pi * uniform(counter, name + "/2", seed))


@dataclass(frozen=True)
class Proposal:
    """A normal distribution of a parameter, of its logarithm or of its logit (`scale` real, log, logit)."""

    mean: float
    sd: float
    scale: str = "real"

    def __post_init__(self):
        if self.scale not in ("real", "log", "logit") or self.sd <= 0:
            raise ValueError(f"no such proposal: {self!r}")

    def value(self, z: Column) -> Column:
        y = self.mean + self.sd * z
        return {"real": y, "log": F.exp(y), "logit": 1 / (1 + F.exp(-y))}[self.scale]

    def log_density(self, x: Column) -> Column:
        """Of the parameter itself: the scale's derivative is in it."""
        y = {"real": x, "log": F.log(x), "logit": F.log(x / (1 - x))}[self.scale]
        stretch = {"real": F.lit(0.0), "log": F.log(x), "logit": F.log(x) + F.log(1 - x)}[self.scale]
        return -F.pow((y - self.mean) / self.sd, F.lit(2)) / 2 - math.log(self.sd) - math.log(2 * math.pi) / 2 - stretch


def proposal_draws(spark: SparkSession, n: int, proposals: dict[str, Proposal], seed: int = 0) -> DataFrame:
    """draw_id, the parameters and log_proposal of `n` independent draws."""
    i = F.col("id")
    rows = spark.range(n).select(i.alias("draw_id"), *[p.value(standard_normal(i, name, seed)).alias(name) for name, p in proposals.items()])
    return rows.withColumn("log_proposal", sum((p.log_density(F.col(name)) for name, p in proposals.items()), F.lit(0.0)))


def pareto_fit(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution from ascending excesses, by Zhang and Stephens' averages.

    The shape has a prior weight of ten values at 1/2.
    """
    n = len(x)
    grid = 30 + int(math.sqrt(n))
    theta = (1 - np.sqrt(grid / (np.arange(1, grid + 1) - 0.5))) / (3 * x[int(n / 4 + 0.5) - 1]) + 1 / x[-1]
    k = np.log1p(-theta[:, None] * x).mean(axis=1)
    profile = n * (np.log(-theta / k) - k - 1)
    weight = np.exp(profile - profile.max())
    mean = float((theta * weight).sum() / weight.sum())
    k0 = float(np.log1p(-mean * x).mean())
    return (n * k0 + 5) / (n + 10), -k0 / mean


def smoothed_weights(lw: DataFrame) -> DataFrame:
    """draw_id, weight, pareto_k from draw_id and lw, the log of unnormalised weights: Pareto-smoothed, with sum 1.

    The largest min(S / 5, 3 sqrt S) of S weights follow a generalised Pareto distribution above the largest of the
    others; they become its quantiles, at most the largest raw weight. A shape (pareto_k) above 0.7 says that the draws
    do not cover the posterior. Fewer than five in the tail, or equal ones, stay as they are, and pareto_k is null.
    The tail visits the driver: 3 sqrt(S) numbers, 95,000 for a thousand million draws. `lw` is persisted.
    """
    lw = lw.select("draw_id", "lw").persist()
    row = lw.agg(F.count("lw").alias("n"), F.max("lw").alias("top")).first()
    top, m = row["top"], math.ceil(min(row["n"] / 5, 3 * math.sqrt(row["n"])))
    w = F.exp(F.col("lw") - F.lit(top))
    tail = lw.filter("lw is not null").orderBy(F.desc("lw"), F.desc("draw_id")).limit(m + 1).collect()[::-1]
    base, tail = (math.exp(tail[0]["lw"] - top), tail[1:]) if len(tail) > m else (0.0, tail)
    x = np.exp(np.array([r["lw"] for r in tail]) - top) - base if tail else np.zeros(0)
    if m < 5 or x[int(m / 4 + 0.5) - 1] <= 0 or x[int(m / 4 + 0.5) - 1] >= x[-1]:
        rows = lw.select("draw_id", w.alias("w"), F.lit(None).cast("double").alias("pareto_k"))
    else:
        k, sigma = pareto_fit(x)
        quantiles = np.minimum(base + sigma / k * ((1 - (np.arange(m) + 0.5) / m) ** -k - 1), 1.0)
        smooth = lw.sparkSession.createDataFrame([(r["draw_id"], float(q)) for r, q in zip(tail, quantiles, strict=True)], "draw_id long, smooth double")
        rows = lw.join(smooth, "draw_id", "left").select("draw_id", F.coalesce("smooth", w).alias("w"), F.lit(k).alias("pareto_k"))
    return rows.crossJoin(rows.agg(F.sum("w").alias("sum"))).select("draw_id", (F.col("w") / F.col("sum")).alias("weight"), "pareto_k")  # one row


def importance_summary(weights: DataFrame, draws: DataFrame, params: list[str]) -> DataFrame:
    """param, mean, sd, effective_size, pareto_k: weighted means and deviations of the parameters."""
    long = F.inline(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params]))
    rows = weights.join(draws, "draw_id").select("weight", "pareto_k", long)
    w, v = F.col("weight"), F.col("value")
    sums = rows.groupBy("param").agg((F.sum(w * v) / F.sum(w)).alias("mean"), (F.sum(w * v * v) / F.sum(w)).alias("square"), (F.pow(F.sum(w), F.lit(2)) / F.sum(w * w)).alias("effective_size"), F.max("pareto_k").alias("pareto_k"))
    return sums.select("param", "mean", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("sd"), "effective_size", "pareto_k")


#: Poisson weights above this have a probability below 1e-15.
MOST_COPIES = 17


def poisson_weight(counter: Column, replicate: Column, seed: int) -> Column:
    """A Poisson(1) number from the hash of a row and a replicate: how often the row is in the replicate."""
    u = uniform(F.concat_ws("/", counter.cast("string"), replicate.cast("string")), "poisson", seed)
    below = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(MOST_COPIES)]
    return sum((F.when(u >= b, 1).otherwise(0) for b in below), F.lit(0))


def bootstrap_means(rows: DataFrame, columns: list[str], replicates: int = 200, key: str = "draw_id", seed: int = 0, prob: float = 0.9) -> DataFrame:
    """name, mean, sd, low, high: the mean of each column, and its spread over replicates with replacement.

    One pass: a row meets the replicates by a weight of its own, and only weighted sums are shuffled, a row for each
    column and replicate. Nulls do not count. The interval is the middle `prob` of the replicates' means.
    """
    long = F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    values = rows.select(F.col(key).alias("_key"), long).filter("value is not null")
    dealt = values.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    weight = poisson_weight(F.col("_key"), F.col("replicate"), seed)
    means = dealt.withColumn("c", weight).filter("c > 0").groupBy("name", "replicate").agg((F.sum(F.col("c") * F.col("value")) / F.sum("c")).alias("m"))
    spread = means.groupBy("name").agg(F.stddev_pop("m").alias("sd"))
    ends = quantiles(means, ["name"], "m", {"low": (1 - prob) / 2, "high": (1 + prob) / 2})
    return values.groupBy("name").agg(F.avg("value").alias("mean")).join(spread, "name").join(ends, "name")
