"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (by a hash of id and text) and laid end to end as one stream of
words, repeated as often as needed and cut into blocks of equal size. Slot i of the mix takes the point
frac(i * golden ratio); the cumulative target shares map the point to a source, and the slot's rank
among its source's slots names the block it takes. So the sources interleave evenly at every scale, and
any prefix of the mix is close to the targets. The schedule runs until every source has as many slots
as its target has blocks: points of the golden ratio leave no gap above 2.62 / N after N of them, so
`ROUNDS` = 3 times the number of blocks is always enough; later slots of a source that has its blocks
name nothing. What a document gives to the mix are its words in blocks that a slot names; the last
block of a source ends at its target. `taken_documents` writes the mix in the order of the slots.

No step needs a source in one task: positions in a stream are sums by hash bucket plus sums within a
bucket, ranks are counts by chunk of slots plus counts within a chunk, and the join of blocks and slots
is on (source, block). Only the table of sources, a row each, passes through the driver, which refuses
more than `MOST_SOURCES`.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its
own, last in the order; a null id counts like any other; rows of one id, and rows repeated as they are,
count as documents of their own, in any order among equal ones; a very long text spans as many blocks
as it needs; an empty table, or one without words, gives targets 0 and an empty mix; other columns,
whatever their names, pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.llm.common import WORD, cut, n_words

#: Words in a block; slots in a chunk.
BLOCK = 16_384
CHUNK = 1 << 18
#: Weights of the sources in code point order, repeating; size of the mix and most of a source, as multiples of sizes.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Slots made for each block; the largest table of sources that the driver takes.
ROUNDS, MOST_SOURCES = 3, 1_000_000
#: The golden ratio's fraction in units of 2^-31; odd, so that 2^31 slots take different points.
GOLDEN, PERIOD = 1327217885, 1 << 31


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares by weight, none above `most` times its source's size.

    Sources ordered by cap over weight reach their caps in that order; a source is capped when its cap
    lies below the level that the sources after it would share.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    cap = (most * F.col("source_size")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("place", place)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = rows.withColumn("level", level).withColumn("capped", F.col("cap") < F.col("weight") * F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(whole)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * final)
    return leveled.withColumn("target", target).select("source", "source_size", "target", F.floor(F.col("target") + 0.5).alias("quota"), "place")


def _slots(batches: Iterator[pa.RecordBatch], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each slot's source and its rank among the slots of that source within its chunk."""
    for batch in batches:
        for chunk in batch.column("chunk").to_pylist():
            slot = np.arange(chunk * CHUNK, (chunk + 1) * CHUNK)
            source = np.searchsorted(ends, slot % PERIOD * GOLDEN % PERIOD / PERIOD, "right").clip(max=len(ends) - 1)
            order = np.argsort(source, kind="stable")
            first = np.searchsorted(source[order], np.arange(len(ends)))
            nth = np.empty(CHUNK, np.int64)
            nth[order] = np.arange(CHUNK) - first[source[order]]
            columns = [pa.array(np.full(CHUNK, chunk), pa.int64()), pa.array(slot, pa.int64()), pa.array(source, pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "slot", "place", "nth"])


def schedule(spark, quotas: list[tuple[int, int]], block: int = BLOCK) -> DataFrame:
    """slot, place (of the source), block: every block of every source once, for (place, quota in words) of each source."""
    blocks = np.array([-(-quota // block) for _, quota in sorted(quotas)], np.int64)
    n = int(blocks.sum())
    if not n:
        return spark.createDataFrame([], "slot long, place int, block long")
    n_chunks = -(-(ROUNDS * n + ROUNDS) // CHUNK)
    chunks = spark.range(0, n_chunks, 1, min(n_chunks, 10_000)).withColumnRenamed("id", "chunk")
    rows = chunks.mapInArrow(partial(_slots, ends=np.cumsum(blocks) / n), "chunk long, slot long, place int, nth long")
    counts = rows.groupBy("chunk", "place").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chunk", "place", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = rows.join(offsets, ["chunk", "place"]).select("slot", "place", (F.col("before") + F.col("nth")).alias("block"))
    wanted = spark.createDataFrame(list(enumerate(blocks.tolist())), "place int, wanted long")
    return ranked.join(wanted, "place").filter("block < wanted").drop("wanted")


def positions(sized: DataFrame) -> DataFrame:
    """Adds `start`, the document's first word in its source's stream, and `nth`, its number within its bucket."""
    same = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source")
    keyed = sized.select("*", same, F.substring("key", 1, 4).alias("_bucket"))
    sums = keyed.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum")).withColumn("_first", F.substring("_bucket", 1, 2))
    # Sums of the buckets before one: those with its first two digits, and those with smaller ones.
    upto = lambda *keys: Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.groupBy("_source", "_first").agg(F.sum("_sum").alias("_sum"), F.min("_bucket").alias("_bucket"))
    first = first.select("_source", "_first", F.coalesce(F.sum("_sum").over(upto("_source")), F.lit(0)).alias("_ahead"))
    near = sums.withColumn("_near", F.coalesce(F.sum("_sum").over(upto("_source", "_first")), F.lit(0)))
    offsets = near.join(first, ["_source", "_first"]).select("_source", "_bucket", (F.col("_ahead") + F.col("_near")).alias("_before"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("key", *[c for c in sized.columns if c != "key"])
    earlier = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.withColumns({"_earlier": earlier, "nth": F.row_number().over(inside)}).join(offsets, ["_source", "_bucket"])
    return placed.withColumn("start", F.col("_before") + F.col("_earlier")).drop("_bucket", "_source", "_before", "_earlier")


def parts(sized: DataFrame, block: int = BLOCK, **choices) -> tuple[DataFrame, DataFrame]:
    """The documents with source_size and target, and what each gives: the columns of `sized`, nth, pass, block, words, slot."""
    spark, by_source = sized.sparkSession, targets(sized, **choices)
    rows = by_source.limit(MOST_SOURCES + 1).collect()  # a row for each source
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    slots = schedule(spark, [(r["place"], r["quota"]) for r in rows], block)
    table = spark.createDataFrame(rows, by_source.schema)
    placed = positions(sized)
    known = placed.join(table, placed["source"].eqNullSafe(table["source"])).drop(table["source"])
    # From each pass over the stream, what of the document lies below the quota, block by block.
    low = lambda e: F.col("start") + e * F.col("source_size")
    high = lambda e: F.least(low(e) + F.col("size"), F.col("quota"))
    passes = F.sequence(F.lit(0), F.lit(choices.get("most", MOST) - 1))

    def pieces(e):
        spans = F.sequence(F.floor(low(e) / block), F.floor((high(e) - 1) / block))
        words = lambda b: F.least(high(e), (b + 1) * block) - F.greatest(low(e), b * block)
        cut = F.transform(spans, lambda b: F.struct(e.alias("pass"), b.alias("block"), words(b).alias("words")))
        return F.when(high(e) > low(e), cut).otherwise(F.array().cast("array<struct<pass:int,block:bigint,words:bigint>>"))

    spread = known.select(*sized.columns, "nth", "place", F.inline(F.flatten(F.transform(passes, pieces))))
    return known.select(*sized.columns, "nth", "source_size", "target"), spread.join(slots, ["place", "block"])


def mix(sized: DataFrame, block: int = BLOCK, **choices) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot for the rows of `sizes`."""
    documents, given = parts(cut(sized.select("doc_id", "source", "size", "key")), block, **choices)
    row = [F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source"), F.substring("key", 1, 4).alias("_bucket"), "nth"]
    taken = given.groupBy(*row).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    joined = documents.select("*", *row[:2]).join(taken, ["_source", "_bucket", "nth"], "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def _key() -> Column:
    return F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.md5("text")))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the key that shuffles the documents."""
    return docs.select("doc_id", "source", n_words("text").alias("size"), _key().alias("key"))


def taken_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, in the order of their slots.

    A whole copy for each pass that takes the document, the last one cut where the target ends. A column
    n_chars, if there is one, follows the text.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    same = [_key().alias("key"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_origin"), F.xxhash64(whole).alias("_row")]
    _, given = parts(cut(docs.select("doc_id", "source", n_words("text").alias("size"), *same)))
    copies = given.groupBy("key", "_origin", "_row", "size", "nth", "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    # Rows equal in every column are one text, joined with what all of them give.
    rows = docs.select(whole.alias("row"), *same)
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("key", "_origin", "_row").orderBy(F.lit(0)))).filter("_n = 1")
    mixed = once.join(copies, ["key", "_origin", "_row"]).orderBy("slot", "key", "pass", "nth")
    text = F.col("row")["text"]
    head = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("words").cast("int"))
    part = F.when(F.col("words") >= F.col("size"), text).otherwise(F.rtrim(F.concat(head, F.array_join(words, ""))))
    mixed = mixed.select("row", part.alias("part"))
    made = {"text": F.col("part"), "n_chars": F.char_length("part").cast("long")}
    return mixed.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
