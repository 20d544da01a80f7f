"""Summaries of draws: means, quantiles, highest-density intervals, histograms, decay of kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.config import Domain
from pulsefield.functions.kernels import Kernel
from pulsefield.operators.ranks import hpdi, quantiles


def long_draws(draws: DataFrame, params: list[str]) -> DataFrame:
    """draw_id, param, value."""
    return draws.select("draw_id", F.inline(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params])))


def summarize_draws(draws: DataFrame, params: list[str]) -> DataFrame:
    """param, mean, sd, p_positive, q025, q975 of each parameter, over the draws that have it."""
    v, rows = F.col("value"), long_draws(draws, params)
    stats = rows.groupBy("param").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.avg((v > 0).cast("double")).alias("p_positive"))
    return stats.join(quantiles(rows, ["param"], "value", {"q025": 0.025, "q975": 0.975}), "param", "left")


def recovery_table(draws: DataFrame, truth: dict[str, float]) -> DataFrame:
    """mean, sd, 5 and 95 per cent and whether these cover the known value."""
    rows = long_draws(draws, list(truth))
    stats = rows.groupBy("param").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    stats = stats.join(quantiles(rows, ["param"], "value", {"q05": 0.05, "q95": 0.95}), "param", "left")
    known = draws.sparkSession.createDataFrame([(k, float(v)) for k, v in truth.items()], "param string, truth double")
    return stats.join(known, "param").withColumn("covered", F.col("truth").between(F.col("q05"), F.col("q95")))


def field_summary(fields: DataFrame, d: Domain, prob: float = 0.9) -> DataFrame:
    """field, idx, day, mean, low, high: the mean and interval of each cell; day is the cell's start in days."""
    means = fields.groupBy("field", "idx").agg(F.avg("value").alias("mean"))
    day = F.when(F.col("field") == "f_t", F.col("idx") / d.n_t * d.t_max).when(F.col("field") == "f_a", F.col("idx") / d.n_s * d.year)
    return means.join(hpdi(fields, ["field", "idx"], prob=prob), ["field", "idx"]).withColumn("day", day)


def intercept_combination(draws: DataFrame, fields: DataFrame, season_of: DataFrame) -> DataFrame:
    """draw_id, intercept: a_0 and the means of the fields, which are identified only together."""
    mean = lambda df, name: df.groupBy("draw_id").agg(F.avg("value").alias(name))
    f_a = fields.filter("field = 'f_a'").join(season_of.select(F.col("season_bin").cast("long").alias("idx")), "idx")
    out = draws.select("draw_id", "a_0")
    for name, part in (("f_t", fields.filter("field = 'f_t'")), ("f_a", f_a), ("f_xy", fields.filter("field = 'f_xy'"))):
        out = out.join(mean(part, name), "draw_id")
    return out.select("draw_id", (F.col("a_0") + F.col("f_t") + F.col("f_a") + F.col("f_xy")).alias("intercept"))


def field_corr(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Pearson correlation of two columns by keys; NaN where one is constant."""
    # corr() itself divides by zero for a constant column under ANSI rules.
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return rows.groupBy(*keys).agg(F.coalesce(r, F.lit(float("nan"))).alias("corr"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, density: bool = False) -> DataFrame:
    """bin (from 1), n (or density): equal widths, the last bin closed; values outside are left out."""
    inside = df.filter(F.col(column).between(low, high))
    at = F.least(F.width_bucket(F.col(column), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)).cast("int")
    counts = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    if not density:
        return counts
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("bin", (F.col("n") / F.col("total") / ((high - low) / bins)).alias("density"))  # one row on the right


def trace(draws: DataFrame, params: list[str]) -> DataFrame:
    return long_draws(draws, params)


def _lags(draws: DataFrame, d: Domain, n_lags: int) -> tuple[DataFrame, Column]:
    lags = draws.sparkSession.range(n_lags).select(F.col("id").alias("lag"), (F.col("id") * float(d.n_t) / (n_lags - 1)).alias("u"))
    return lags, F.col("u") / d.n_t * d.t_max


def decay_curve(draws: DataFrame, kernel: Kernel, d: Domain, n_lags: int = 250, at_mean: bool = False) -> DataFrame:
    """draw_id (or -1 at the mean parameters), lag, days, value of a temporal kernel."""
    lags, days = _lags(draws, d, n_lags)
    pars = draws.select("draw_id", *kernel.params)
    if at_mean:
        pars = draws.agg(*[F.avg(p).alias(p) for p in kernel.params]).withColumn("draw_id", F.lit(-1).cast("long"))
    rows = pars.crossJoin(F.broadcast(lags))  # n_lags rows
    return rows.select("draw_id", "lag", days.alias("days"), kernel.pdf(F.col("u"), pars=kernel.pars()).alias("value"))


def decay_summary(curve: DataFrame) -> DataFrame:
    """draw_id, peak, half_life, to_1_percent, time_constant of each draw's curve.

    The time constant is minus one over the slope of the logarithm between the first lag and the last
    of the values above one per cent of the peak, when there are more than five.
    """
    peak = F.max("value").over(Window.partitionBy("draw_id"))
    rows = curve.withColumn("peak", peak)
    high = F.col("value") > F.col("peak") * 0.01
    ranked = rows.withColumn("nth", F.when(high, F.sum(high.cast("int")).over(Window.partitionBy("draw_id").orderBy("lag"))))
    at = rows.select("draw_id", F.col("lag").alias("l"), F.col("days").alias("d"))
    summary = ranked.groupBy("draw_id").agg(
        F.max("peak").alias("peak"), F.min(F.when(F.col("value") <= F.col("peak") / 2, F.col("days"))).alias("half_life"), F.min(F.when(F.col("value") <= F.col("peak") * 0.01, F.col("days"))).alias("to_1_percent"),
        F.max("nth").alias("k"), F.min_by("value", "nth").alias("v0"), F.max_by("value", "nth").alias("v1"), F.min("days").alias("d0"),
    ).withColumn("l", F.col("k") - 1)
    slope = (F.log("v1") - F.log("v0")) / (F.col("d") - F.col("d0"))
    constant = F.when((F.col("k") > 5) & (F.col("v1") != F.col("v0")), -1 / slope)
    return summary.join(at, ["draw_id", "l"], "left").select("draw_id", "peak", "half_life", "to_1_percent", constant.alias("time_constant"))


def decay_means(summary: DataFrame) -> DataFrame:
    """One row: mean and deviation of each characteristic."""
    names = ("peak", "half_life", "to_1_percent", "time_constant")
    return summary.agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
