"""Best-fit packing by minimum bin slack.

Texts become token ids once, in the tasks that read them; what is kept is a row per piece: its length
and a checksum. How to fill sequences depends on the lengths alone, and there are at most `CAPACITY`
different ones, so the plan is made on the histogram: the largest length left opens a sequence, a
bitset subset-sum over the other lengths finds the fullest combination that still fits, and the pattern
is removed as many times as the counts allow. Each pattern uses up a length, so the plan stays small
(its size depends on the number of lengths, not of documents) and is broadcast.

Every piece then gets its rank among the pieces of its length (counted by length and a hash bucket, so
that a length with very many pieces is still spread), and the plan maps length and rank to a sequence
and an offset.

Defined cases: a null text counts as empty, which is the single end token; rows of one id are packed as
rows of their own; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.llm.common import cut, shuffle_partitions

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker keeps; the other words are encoded again in each call.
KEPT = 600_000
#: Bytes of text whose words are encoded together, by whole texts.
TOGETHER = 8 << 20


def tokenizer(vocabulary: str | None = None):
    """The public tokenizer; `vocabulary` is a path, by default that of the installed file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    return Tokenizer.from_file(vocabulary)


def _parts(word: bytes) -> tuple[bytes, bytes]:
    """A word in lower case and the marks at its end, where the tokenizer separates them for certain."""
    core = word.rstrip(b".,!?;:")
    if core and (48 <= core[-1] < 58 or 97 <= core[-1] | 32 < 123):
        return core.lower(), word[len(core) :]
    return word, b""


def _one_by_one(tok, ws: list[str]) -> list[bytes]:
    """The ids of words encoded as one text, told apart by the tokens' offsets."""
    got = tok.encode(" ".join(ws), add_special_tokens=False)
    starts = np.cumsum([0, *(len(w) + 1 for w in ws[:-1])])
    owner = np.searchsorted(starts, np.array([o[0] for o in got.offsets], np.int64), "right") - 1
    cuts = (4 * np.searchsorted(owner, np.arange(len(ws) + 1))).tolist()
    raw = np.array(got.ids, "<u4").tobytes()
    return [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


def _encoded(tok, closing: np.ndarray, ws: list[bytes], together: int = 20_000) -> dict[bytes, bytes]:
    """The ids of each word; closing: whether an id ends a run of letters.

    A word of letters is one run, so where a text of such words has as many closing tokens as words,
    these tell the words apart; offsets, which cost as much again, are made for the others.
    """
    texts = [w.decode() for w in ws]
    of_letters = [w for w, t in zip(ws, texts, strict=True) if t.isalpha()]
    others = [w for w, t in zip(ws, texts, strict=True) if not t.isalpha()]
    out = {}
    for low in range(0, len(of_letters), together):
        some = of_letters[low : low + together]
        ids = np.array(tok.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
        cuts = 4 * (np.flatnonzero(closing[ids]) + 1)
        if len(cuts) != len(some):
            others += some  # a letter that the tokenizer takes apart
            continue
        raw, cuts = ids.tobytes(), [0, *cuts.tolist()]
        out.update((w, raw[x:y]) for w, x, y in zip(some, cuts, cuts[1:], strict=False))
    for low in range(0, len(others), together):
        some = others[low : low + together]
        out.update(zip(some, _one_by_one(tok, [w.decode() for w in some]), strict=True))
    return out


@cache
def encoder(vocabulary: str | None = None):
    """A function from a list of texts (bytes) to their ids, each a run of little-endian uint32.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words one
    after the other, and each different word is encoded once. A Python worker keeps the ids of up to
    `KEPT` words and of as many words without case and marks from task to task; the others are encoded
    again in the next call, with the same result.
    """
    tok, kept, cores = tokenizer(vocabulary), {}, {}
    closing = np.zeros(tok.get_vocab_size() + 1, bool)
    closing[[k for t, k in tok.get_vocab().items() if t.endswith("</w>")]] = True

    def encode(texts: list[bytes | None]) -> list[bytes]:
        split = [(t or b"").split() for t in texts]
        ids = {w: kept.get(w) for w in set().union(*split)}  # a word of white space alone has no ids: b"", not None
        parts = [(w, *_parts(w)) for w, known in ids.items() if known is None]
        asked = {a for _, a, _ in parts}.union(b for _, _, b in parts if b)
        found = {p: cores.get(p) for p in asked}
        fresh = _encoded(tok, closing, [p for p, known in found.items() if known is None])
        found.update(fresh)
        ids.update((w, found[a] + found[b] if b else found[a]) for w, a, b in parts)
        if len(cores) < KEPT:
            cores.update(fresh)
        if len(kept) < KEPT:
            kept.update((w, ids[w]) for w, _, _ in parts)
        return [b"".join(map(ids.__getitem__, ws)) for ws in split]

    return encode


_PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str | None, capacity: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(vocabulary), np.array([END], "<u4").tobytes()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes, dtype=np.int64) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            some = batch.slice(low, high - low)
            doc_ids, rows = some.column("doc_id").to_pylist(), []
            for doc_id, ids in zip(doc_ids, encode(some.column("text").cast(pa.binary()).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (some.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of every text and its end token, cut at `capacity`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_pieces, vocabulary=vocabulary, capacity=capacity), _PIECES.format(kind=kind))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of at most counts[length] items each whose lengths add up to the most, within `room`.

    Longer items are tried first and shorter ones used as little as possible, which keeps the short
    ones for later sequences.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        many, before = min(counts[length], room // length), reach
        step = 1
        while many > 0:  # any number of items up to `many`, by doubling
            step = min(step, many)
            reach |= reach << length * step & mask
            many -= step
            step *= 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> at & 1:
            at -= length
            used[length] = used.get(length, 0) + 1
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows length, first rank, items per sequence, first sequence, first offset; sorted by length and rank."""
    counts, ranks, rows, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    lengths = sorted(counts)
    while lengths:
        if not counts[lengths[-1]]:
            lengths.pop()
            continue
        top = lengths[-1]
        counts[top] -= 1
        pattern = fullest(counts, capacity - top)
        counts[top] += 1
        pattern[top] = pattern.get(top, 0) + 1
        times, offset = min(counts[x] // n for x, n in pattern.items()), 0
        for x in sorted(pattern, reverse=True):
            rows.append((x, ranks[x], pattern[x], sequence, offset))
            offset += x * pattern[x]
            ranks[x] += times * pattern[x]
            counts[x] -= times * pattern[x]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    rows = shared.value
    starts = rows[:, 0] << 48 | rows[:, 1]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(starts, length << 48 | rank, "right") - 1
        past = rank - rows[at, 1]
        each = rows[at, 2]
        out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        out += [pa.array(rows[at, 3] + past // each, pa.int64()), pa.array(rows[at, 4] + past % each * length, pa.int64())]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset."""
    rows = cut(pieces(docs, vocabulary, capacity))  # tokens are made once
    by_length = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # `capacity` rows at most
    shared = docs.sparkSession.sparkContext.broadcast(plan(by_length, capacity))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * shuffle_partitions(docs))))
    counted = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("nth", nth).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        partial(_place, shared=shared), _PIECES.format(kind=kind) + ", sequence_id long, offset long"
    )
