"""Chat formatting by quotation linking.

Messages quote earlier ones with leading '>' marks, nested to any level. Each message is parsed into its
own text and its quoted passages (runs of lines of one level; a passage of several lines also counts
line by line, for partial quotes). Passages are normalised to lower-case letters and digits and hashed;
a quoted passage joins the latest earlier message of its conversation whose own text has that passage.
A message answers the original of its outermost linked quotes (most characters first, then the latest);
without a link it answers the turn before it. The conversation is then written in reply order, each
message after the one it answers and without quotes: a run of turns that each answer the one before
stays together, and the branches off a run follow it, the latest branching point first.

No step needs a whole conversation in one task. "The latest earlier turn" and ranks are found by
blocks of `TURNS` turn numbers and maxima or counts over blocks; branches resolve by pointer doubling.

Defined cases: a null text is an empty message; rows with a null conv_id or turn have no position,
parent or links; rows repeated with one (conv_id, turn) share parent and branch and take positions in
the order of role and text; very long texts are parsed whole; an empty table gives an empty result; other
columns, whatever their names, are never read. Turns are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.llm.common import cut

TURNS = 4096
_MARKS = regex.compile(r"(?:[ \t]*>)+ ?")
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
#: How a line that only introduces a quote ends.
_INTRODUCES = regex.compile(r"\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", regex.IGNORECASE)


def parsed(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text and its passages (level, text); level 0 is its own."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = None
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        level = marks.group().count(">") if marks else 0
        body = line[marks.end() :] if marks else line
        if level and last == 0 and own and _INTRODUCES.search(own[-1]):
            own.pop()
            passages[-1][1].pop()
        if not level:
            own.append(line)
        if not body.strip():
            last = None
        elif level == last:
            passages[-1][1].append(body)
        else:
            passages.append((level, [body]))
            last = level
    units = [(level, "\n".join(lines)) for level, lines in passages if lines]
    units += [(level, line) for level, lines in passages if len(lines) > 1 for line in lines]
    return "\n".join(own).strip(), units


def normalised(passage: str) -> str:
    return _OTHER.sub(" ", passage.lower()).strip()


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("size", pa.int64())]))
    for batch in batches:
        own, units = [], []
        for text in batch.column("text").to_pylist():
            mine, found = parsed(text or "")
            own.append(mine)
            keyed = ((level, normalised(p)) for level, p in found)
            units.append([{"level": level, "hash": int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "little", signed=True), "size": len(p)} for level, p in keyed if p])
        columns = [batch.column(c) for c in ("conv_id", "turn", "role")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.string()), pa.array(units, unit)], ["conv_id", "turn", "role", "text", "units"])


def _latest_before(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Adds `before`: the largest `value` among rows of the same keys with a smaller turn."""
    blocked = rows.withColumns({"_value": value, "_block": F.floor(F.col("turn") / TURNS)})
    inside = Window.partitionBy(*keys, "_block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(*keys, "_block").agg(F.max("_value").alias("_most"))
    blocks = blocks.withColumn("_ahead", F.max("_most").over(ahead)).drop("_most")
    joined = blocked.withColumn("_inside", F.max("_value").over(inside)).join(blocks, [*keys, "_block"])
    return joined.withColumn("before", F.coalesce("_inside", "_ahead")).drop("_value", "_block", "_inside", "_ahead")


def quote_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, size, original: quoted passages with the turn they come from."""
    units = messages.select("conv_id", "turn", F.inline("units")).groupBy("conv_id", "turn", "level", "hash").agg(F.max("size").alias("size"))
    found = _latest_before(units, ["conv_id", "hash"], F.when(F.col("level") == 0, F.col("turn")))
    return found.filter("level > 0 and before is not null").select("conv_id", "turn", "level", "size", F.col("before").alias("original"))


def replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, previous, parent, n_linked of every turn."""
    turns = messages.select("conv_id", "turn").distinct()
    ordered = _latest_before(turns, ["conv_id"], F.col("turn")).withColumnRenamed("before", "previous")
    votes = quote_links(messages).groupBy("conv_id", "turn", "original").agg(F.min("level").alias("level"), F.sum("size").alias("size"), F.count("*").alias("n"))
    chosen = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "size", "original"))["original"].alias("original"), F.sum("n").alias("n_linked"))
    joined = ordered.join(chosen, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", "previous", F.coalesce("original", "previous").alias("parent"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def _paths(branches: DataFrame) -> DataFrame:
    """conv_id, start, path of every branch (conv_id, start, above, point): the branching points from its root."""
    step = F.array(F.struct((-F.col("point")).alias("back"), F.col("start").alias("start")))
    state = cut(branches.select("conv_id", "start", "above", F.when(F.col("above").isNull(), F.array().cast("array<struct<back:bigint,start:bigint>>")).otherwise(step).alias("path")))
    while state.filter("above is not null").limit(1).count():
        up = state.select("conv_id", F.col("start").alias("above"), F.col("above").alias("next"), F.col("path").alias("head"))
        joined = state.join(up, ["conv_id", "above"], "left")
        state = cut(joined.select("conv_id", "start", F.col("next").alias("above"), F.concat(F.coalesce("head", F.array().cast("array<struct<back:bigint,start:bigint>>")), "path").alias("path")))
    return state.select("conv_id", "start", "path")


def format_conversations(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, position (from 0), parent_turn, n_quotes, n_linked, text without quotes."""
    kinds = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text"]
    schema = "conv_id long, turn long, role string, text string, units array<struct<level:int,hash:long,size:long>>"
    everything = cut(table.select(*kinds).mapInArrow(_messages, schema))  # messages are parsed once
    quotes = F.size(F.array_distinct(F.filter("units", lambda u: u["level"] > 0))).alias("n_quotes")
    placeless = F.col("conv_id").isNull() | F.col("turn").isNull()
    known = everything.filter(~placeless)
    turns = replies(known)
    # A run starts at the first turn and wherever a turn does not answer the one before it.
    starts = F.when(F.col("previous").isNull() | (F.col("parent") != F.col("previous")), F.col("turn"))
    turns = _latest_before(turns.withColumn("_start", starts), ["conv_id"], F.col("_start"))
    turns = cut(turns.withColumn("run", F.coalesce("_start", "before")).drop("_start", "before"))
    run_of = turns.select("conv_id", F.col("turn").alias("point"), F.col("run").alias("above"))
    heads = turns.filter("turn = run").select("conv_id", F.col("run").alias("start"), F.when(F.col("previous").isNotNull(), F.col("parent")).alias("point"))
    paths = _paths(heads.join(run_of, ["conv_id", "point"], "left"))
    rows = known.select("conv_id", "turn", "role", "text", quotes).join(turns, ["conv_id", "turn"]).withColumn("_block", F.floor(F.col("turn") / TURNS))
    counts = rows.groupBy("conv_id", "run", "_block").agg(F.count("*").alias("n")).join(paths.withColumnRenamed("start", "run"), ["conv_id", "run"])
    ahead = Window.partitionBy("conv_id").orderBy("path", "run", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "run", "_block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "run", "_block").orderBy("turn", "role", "text"))
    placed = rows.withColumn("nth", nth).join(offsets, ["conv_id", "run", "_block"])
    out = placed.select("conv_id", "turn", "role", (F.col("ahead") + F.col("nth") - 1).alias("position"), F.col("parent").alias("parent_turn"), "n_quotes", "n_linked", "text")
    none = F.lit(None).cast("long")
    rest = everything.filter(placeless).select("conv_id", "turn", "role", none.alias("position"), none.alias("parent_turn"), quotes, F.lit(0).cast("long").alias("n_linked"), "text")
    return out.unionByName(rest)
