"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so no list of neighbours is ever built, and a node with very
many links is spread by the join. Lineage is cut after each round in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefield.llm.common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node in links (a, b); an empty table gives an empty one."""
    current = cut(links.select("a", "b").filter("a != b").distinct())
    state = None
    while True:  # every round but the last moves a link to a smaller node, so this ends
        new = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            break
        state = new
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))
        small = large.join(least, "a").select(F.inline(pairs)).filter("x != y").distinct()
        current = cut(small.select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
