"""Daily counts over a stream of events; late events up to `delay` are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """day, cell_id, n for a streaming frame with ts and cell_id (see operators.prepare.prepare)."""
    windowed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "cell_id")
    return windowed.agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "cell_id", "n")
