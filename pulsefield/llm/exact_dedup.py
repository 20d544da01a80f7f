"""Exact dedup by two passes over a Bloom filter, in DataFrame functions alone.

Texts are equal when they are the same code points; nothing is normalised, and a null text counts as empty.

1. The first pass reads each text to a 64-bit hash, which names a word of the filter and up to four of the
   word's 64 bits. Equal choices are counted map-side; each word then keeps the bits that two different hashes
   set, or one hash twice. What is shuffled is 16 bytes for each distinct text, never a text.
2. The filter is broadcast in dense segments of `SEGMENT` words, and the second pass looks up every row. A row
   with a bit that nothing set twice is certainly alone: it passes straight through, unshuffled. The others,
   which are all repeated texts and the filter's false positives, are grouped by SHA-256.

The filter has `BITS` bits for each row and `MOST_WORDS` words (128 MB) at most, whatever the table's size. A
table beyond that gets a fuller filter: more of its rows are grouped, and the result is the same. Groups of any
size meet the row that stays in `attach`, without a task for each group.

Defined cases: of equal texts the row with the largest id stays, and of rows that share that id exactly one;
null ids are less than all others, so a group of null ids alone has a null keep_id; very long texts are hashed
whole; an empty table gives an empty result; other columns, whatever their names, are never read by `mark` and
are kept by `kept_documents`. Ids may be of any type that has an order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefield.llm.common import attach, cut

#: Bits of the filter for each row; words in a segment; words at most.
BITS, SEGMENT, MOST_WORDS = 16, 1024, 1 << 24
_MASK = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(_h, {6 * k}) & 63L AS int))" for k in range(4))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _placed(rows: DataFrame, n_words: int) -> DataFrame:
    """`rows` (with _h, the hash of their text) with their word of the filter and its mask of bits."""
    return rows.withColumns({"_word": F.pmod(F.shiftrightunsigned("_h", 24), F.lit(n_words)), "_mask": F.expr(_MASK)})


def repeated_filter(docs: DataFrame, n_words: int) -> DataFrame:
    """segment, bits: for each of `SEGMENT` words of a segment the bits that two hashes set, or one hash twice."""
    rows = _placed(docs.select(F.xxhash64(_text()).alias("_h")), n_words)
    masks = rows.groupBy("_word", "_mask").agg(F.count("*").alias("n"))
    every = docs.sparkSession.range(n_words).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_mask"), F.lit(1).cast("long").alias("n"))

    def add(seen: Column, x: Column) -> Column:
        again = seen["once"].bitwiseAND(x["_mask"]).bitwiseOR(F.when(x["n"] > 1, x["_mask"]).otherwise(F.lit(0).cast("long")))
        return F.struct(seen["once"].bitwiseOR(x["_mask"]).alias("once"), seen["twice"].bitwiseOR(again).alias("twice"))

    # Distinct masks of a word, some four of them: hashes spread them whatever the texts.
    words = masks.unionByName(every).groupBy("_word").agg(F.collect_list(F.struct("_mask", "n")).alias("m"))
    zero = F.lit(0).cast("long")
    words = words.select("_word", F.aggregate("m", F.struct(zero.alias("once"), zero.alias("twice")), add)["twice"].alias("bits"))
    segments = words.groupBy(F.floor(F.col("_word") / SEGMENT).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("_word", "bits"))).alias("w"))
    return segments.select("segment", F.col("w.bits").alias("bits"))


def _filtered(docs: DataFrame, columns: list[Column]) -> tuple[DataFrame, int]:
    """The given columns of `docs` and `repeated`, whether a row's text may be repeated; and the number of rows."""
    n = docs.count()
    n_words = min(MOST_WORDS, max(SEGMENT, 1 << math.ceil(math.log2(max(1, n * BITS / 64)))))
    found = F.broadcast(repeated_filter(docs, n_words))  # 8 bytes a word, MOST_WORDS at most
    rows = _placed(docs.select(*columns, F.xxhash64(_text()).alias("_h")), n_words).withColumn("segment", F.floor(F.col("_word") / SEGMENT))
    names = rows.columns[: len(columns)]
    bits = F.get("bits", F.pmod("_word", F.lit(SEGMENT)).cast("int"))
    return rows.join(found, "segment", "left").select(*names, (bits.bitwiseAND(F.col("_mask")) == F.col("_mask")).alias("repeated")), n


def mark(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    digest = F.sha2(_text(), 256).alias("text_sha256")
    rows, n = _filtered(docs, [F.col("doc_id"), digest])
    # `row` names a row from here on: the table is cut, so it is not computed again.
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    alone = rows.filter("not repeated").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = rows.filter("repeated").select("doc_id", "text_sha256", "row")
    groups = some.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size"))
    met = attach(some, groups, ["text_sha256"], "group_size", n, F.col("row"))
    return alone.unionByName(met.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: of the largest id, then of the largest row hash.

    Rows that are certainly alone are not shuffled; of the others each task sends one for each text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows, _ = _filtered(docs, [row, F.sha2(_text(), 256).alias("digest")])
    some = rows.filter("repeated").groupBy("digest").agg(F.max_by("row", F.struct(F.col("row.doc_id"), F.xxhash64("row"))).alias("row"))
    return rows.filter("not repeated").select("row").unionByName(some.select("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
