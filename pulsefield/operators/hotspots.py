"""Posterior means on the grid, hot and cold cells, and daily counts inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.config import Domain
from pulsefield.operators.prepare import grid_rowcol
from pulsefield.operators.ranks import quantiles

#: Percentiles of hot and cold cells by method.
METHODS = {"auto": (0.98, 0.02), "98/2": (0.98, 0.02), "90/10": (0.9, 0.1)}


def _placed(df: DataFrame, d: Domain) -> DataFrame:
    row, col = grid_rowcol("cell_id", d)
    return df.withColumns({"grid_row": row, "grid_col": col})


def grid_post_mean(fields: DataFrame, d: Domain) -> DataFrame:
    """cell_id, post_mean, grid_row, grid_col of the space field."""
    means = fields.filter("field = 'f_xy'").groupBy(F.col("idx").cast("int").alias("cell_id")).agg(F.avg("value").alias("post_mean"))
    return _placed(means, d)


def piece_post_mean(fields: DataFrame, overlay: DataFrame, effect: DataFrame, d: Domain, key: str = "cov_id") -> DataFrame:
    """The mean of field plus covariate effect on every common part of a cell and a covariate polygon."""
    f = fields.filter("field = 'f_xy'").groupBy(F.col("idx").cast("int").alias("cell_id")).agg(F.avg("value").alias("f"))
    b = effect.groupBy(key).agg(F.avg("b_0").alias("b"))
    pieces = overlay.join(f, "cell_id").join(b, key).select("cell_id", key, (F.col("f") + F.col("b")).alias("post_mean"))
    return _placed(pieces, d)


def cell_covariate(grid: DataFrame, overlay: DataFrame, effect: DataFrame, key: str = "cov_id") -> DataFrame:
    """cell_id, post_mean: the covariate effect by area; 0 for cells that no polygon covers."""
    b = effect.groupBy(key).agg(F.avg("b_0").alias("b"))
    by_cell = overlay.join(b, key).groupBy("cell_id").agg((F.sum(F.col("b") * F.col("area")) / F.sum("area")).alias("m"))
    return grid.select("cell_id").join(by_cell, "cell_id", "left").select("cell_id", F.coalesce("m", F.lit(0.0)).alias("post_mean"))


def hotspots(cells: DataFrame, method: str = "auto") -> DataFrame:
    """kind (hot, cold), rank, cell_id, post_mean: cells at or beyond the percentiles; ties go by cell_id."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; use one of {sorted(METHODS)}")
    hot, cold = METHODS[method]
    limits = quantiles(cells, [], "post_mean", {"hot_at": hot, "cold_at": cold})
    rows = cells.crossJoin(limits)  # one row on the right
    kinds = F.array(F.when(F.col("post_mean") >= F.col("hot_at"), "hot"), F.when(F.col("post_mean") <= F.col("cold_at"), "cold"))
    rows = rows.select("cell_id", "post_mean", F.explode(F.array_compact(kinds)).alias("kind"))
    order = F.when(F.col("kind") == "hot", -F.col("post_mean")).otherwise(F.col("post_mean"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(order, "cell_id"))  # grid cells only
    return rows.select("kind", rank.alias("rank"), "cell_id", "post_mean")


def check_events(ev: DataFrame, columns: tuple[str, ...] = ("ts", "cell_id")) -> DataFrame:
    """One row: how many values are missing in each needed column; raises if a column is."""
    missing = [c for c in columns if c not in ev.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return ev.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns], F.count("*").alias("n"))


def events_in_cells(ev: DataFrame, cells: DataFrame) -> DataFrame:
    """Events in any of the cells, each once."""
    return ev.join(cells.select("cell_id"), "cell_id", "left_semi")


def daily_counts(ev: DataFrame, hot: DataFrame, mode: str = "combined", top: int = 5) -> DataFrame:
    """kind, (rank,) day, n; days without events are absent."""
    if mode not in ("combined", "top5"):
        raise ValueError(f"unknown mode {mode!r}; use combined or top5")
    keys = ["kind"] if mode == "combined" else ["kind", "rank"]
    cells = hot if mode == "combined" else hot.filter(F.col("rank") <= top)
    rows = ev.select("cell_id", F.to_date("ts").alias("day")).groupBy("cell_id", "day").agg(F.count("*").alias("n"))
    return rows.join(cells.select("cell_id", *keys), "cell_id").groupBy(*keys, "day").agg(F.sum("n").alias("n"))
