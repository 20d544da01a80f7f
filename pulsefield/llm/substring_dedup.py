"""Substring dedup: repeated windows of words, found by FM-indexes over shards of candidate stretches.

A window is `WINDOW` consecutive words. A word goes when a window that covers it also starts in a
document with a smaller id.

1. Chunks. The rows are shuffled once, by a hash of id and text, into chunks of about `CHUNK_BYTES`; the
   three passes over the texts below read that one exchange. A chunk's rows are put in one order, so that
   a later pass can read an answer that follows the order of what an earlier pass has sent.
2. Anchors. Every window has an anchor: of its runs of `ANCHOR` words, the one with the least hash.
   Equal windows have equal anchors, and neighbouring windows mostly share theirs, so a text has about
   one anchor for four words. A chunk sends its distinct anchors, sorted, six bytes each, to buckets; a
   bucket answers with a bit for each: whether another row has it, and whether very many have.
3. Stretches. A stretch is a run of windows with one anchor that another row has. A chunk sends its
   distinct stretches (compressed, with their least and largest id) to shards, dealt by anchor, so that
   equal windows meet. Stretches of an anchor in more than `COMMON` rows are cut into single windows
   and dealt by the whole window, so that frequent phrases spread too.
4. Shards. A shard builds a compressed FM-index (a wavelet matrix) of its distinct stretches and streams
   them through it by backward search. Where the matching statistic reaches `WINDOW` words, the
   interval's least document id is the verdict on that window; the shard answers each chunk with the
   verdicts on its stretches, in the order sent.
5. The chunk lays the verdicts on its texts: words covered by a window that a smaller id has are removed.

No step sees a group that grows with one passage: a chunk sends a passage once, however many of its rows
hold it. Hashes choose anchors and deal the work; the search itself compares words.

Defined cases: null texts have no words; texts shorter than a window lose nothing; a text that repeats
itself loses nothing by that; rows of one id are judged one by one and do not remove each other's
words; rows with a null id neither lose words nor cause removal; very long texts are one row of a chunk
and are never cut up; an empty table gives an empty result; other columns, whatever their names, are
never read by `dedup` and pass through `cut_texts`. Ids are integers.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefield.llm.common import WORD
from pulsefield.llm.fm_index import matched_minimum

WINDOW = 13
ANCHOR = 7
#: An anchor in more rows than this deals its windows one by one.
COMMON = 5_000
#: Bytes of text for each chunk, each bucket of anchors and each shard of stretches.
CHUNK_BYTES, BUCKET_BYTES, SHARD_BYTES = 4 << 20, 16 << 20, 6 << 20
#: Bytes whose words are hashed together.
PIECE = 1 << 17
_U = np.uint64
_WORD = re.compile(WORD.encode())
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], _U)
_BASE, _BACK = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
#: Bytes of an anchor that a bucket compares; chance meetings cost a stretch and change no result.
SENT = 6


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, _U)
    p[0] = 1
    return np.multiply.accumulate(p)


class _Hasher:
    """A hash of each word of a buffer: its bytes as digits of a number modulo 2^64, mixed."""

    def __init__(self):
        self.up = self.down = np.ones(0, _U)

    def __call__(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, low = np.empty(len(starts), _U), 0
        while low < len(starts):
            first = starts[low]
            high = max(low + 1, int(np.searchsorted(ends, first + PIECE, "right")))
            n = int(ends[high - 1] - first)
            if n >= len(self.up):
                self.up, self.down = _powers(_BASE, n + PIECE), _powers(_BACK, n + PIECE)
            total = np.zeros(n + 1, _U)
            np.cumsum((buffer[first : first + n].astype(_U) + _U(1)) * self.up[:n], out=total[1:])
            a, b = starts[low:high] - first, ends[low:high] - first
            out[low:high] = (total[b] - total[a]) * self.down[a]
            low = high
        out = (out ^ (out >> _U(32))) * _ODD[0]
        return (out ^ (out >> _U(29))) * _ODD[2]


_hashes = _Hasher()


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` words."""
    n = max(0, len(h) - length + 1)
    g = np.zeros(n, _U)
    for k in range(length):
        g = g * _ODD[1] + h[k : k + n]
    g = (g ^ (g >> _U(31))) * _ODD[0]
    return g ^ (g >> _U(29))


class Chunk:
    """The texts of a chunk's rows, in a fixed order, as one run of words with hashes and anchors.

    order: the rows in that order; texts: their words joined by one space; size: their number of words.
    Rows with an id and a window are `judged`; `first` is the place of their first word in the run.
    """

    def __init__(self, table: pa.Table):
        ids, ties = table.column("doc_id").to_pylist(), table.column("tie").to_pylist()
        raw = table.column("text").cast(pa.binary()).to_pylist()
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, ties[k], raw[k] or b""))
        self.raw = [raw[k] or b"" for k in self.order]
        self.texts = [b" ".join(t.split()) for t in self.raw]
        self.size = [t.count(b" ") + 1 if t else 0 for t in self.texts]
        self.judged = [k for k, r in enumerate(self.order) if ids[r] is not None and self.size[k] >= WINDOW]
        self.buffer = b"\n".join(self.texts[k] for k in self.judged) + b"\n"
        view = np.frombuffer(self.buffer, np.uint8)
        self.ends = np.flatnonzero((view == 32) | (view == 10)) if self.judged else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if self.judged else self.ends
        sizes = np.array([self.size[k] for k in self.judged], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.owner = np.array([ids[self.order[k]] for k in self.judged], np.int64)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.hashes = _hashes(view, self.starts, self.ends)
        if not self.judged:
            self.windows = self.run_start = self.run_length = np.zeros(0, np.int64)
            self.anchors, self.of_run = np.zeros(0, _U), self.windows
            return
        runs = _runs(self.hashes, ANCHOR)
        # The offset rides in the four lowest bits, so that one running minimum finds value and place.
        high, n = runs & ~_U(15), len(self.hashes) - WINDOW + 1
        least = high[:n].copy()
        for k in range(1, WINDOW - ANCHOR + 1):
            np.minimum(least, high[k : k + n] | _U(k), out=least)
        at = (least & _U(15)).astype(np.int64) + np.arange(n)
        windows = np.flatnonzero(self.row[:n] == self.row[WINDOW - 1 :])
        at = at[windows]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)]))
        self.run_start = windows[new]
        self.run_length = np.diff(np.append(new, len(windows)))
        self.anchors, self.of_run = np.unique(runs[at[new]], return_inverse=True)

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the anchors by bucket and sent value, and their buckets in that order."""
        bucket = ((self.anchors >> _U(40)) % _U(buckets)).astype(np.int64)
        order = np.lexsort((self.anchors & _U((1 << 8 * SENT) - 1), bucket))
        return order, bucket[order]

    def flags(self, answers: list[tuple[int, bytes, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """For each run, whether its anchor is shared and whether it is common; answers: bucket and bits."""
        order, bucket = self.by_bucket(buckets)
        found, low = np.zeros((2, len(order)), bool), 0
        for b, *bits in sorted(answers):
            high = low + int(np.searchsorted(bucket[low:], b, "right"))
            for kind, packed in enumerate(bits):
                found[kind, order[low:high]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=high - low).astype(bool)
            low = high
        return found[0][self.of_run], found[1][self.of_run]

    def stretches(self, shared: np.ndarray, common: np.ndarray, shards: int) -> _Stretches:
        own = np.flatnonzero(shared & ~common)
        starts, lengths = [self.run_start[own]], [self.run_length[own]]
        keys = [self.anchors[self.of_run[own]]]
        if common.any():
            each = np.flatnonzero(common)
            n = self.run_length[each]
            one = np.repeat(self.run_start[each] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            starts.append(one)
            lengths.append(np.ones(len(one), np.int64))
            keys.append(_runs(self.hashes, WINDOW)[one])
        start, length, key = np.concatenate(starts), np.concatenate(lengths), np.concatenate(keys)
        cut = zip(self.starts[start].tolist(), self.ends[start + length + (WINDOW - 2)].tolist(), strict=True)
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(self.buffer[a:b], len(number)) for a, b in cut), np.int64, len(start))
        _, once = np.unique(of, return_index=True)
        return _Stretches(start, length, of, list(number), length[once], ((key[once] >> _U(20)) % _U(shards)).astype(np.int64))


class _Stretches:
    """Occurrences (start, length in windows, number of the text) and the distinct texts with lengths and shards."""

    def __init__(self, start, length, of, texts, windows, shard):
        self.start, self.length, self.of, self.texts, self.windows, self.shard = start, length, of, texts, windows, shard

    def by_shard(self) -> list[tuple[int, np.ndarray]]:
        order = np.argsort(self.shard, kind="stable")
        cuts = np.flatnonzero(np.diff(self.shard[order])) + 1
        return [(int(self.shard[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


#: What passes between chunks and buckets or shards: kind 0 anchors, 1 stretches; `n` items.
_SENT = "chunk long, kind int, part long, n long, a binary, b binary"
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
_NAMES = ("chunk", "kind", "part", "n", "a", "b")


def _sent(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_KINDS)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _received(table: pa.Table) -> list[tuple]:
    return list(zip(*(table.column(c).to_pylist() for c in _NAMES), strict=True))


def _anchors(table: pa.Table, buckets: int) -> pa.Table:
    """For each bucket, the chunk's anchors there (planes of bytes, sorted) and the number of rows of each."""
    chunk = Chunk(table)
    name = table.column("chunk")[0].as_py()
    once = np.unique(np.stack([chunk.of_run, chunk.row[chunk.run_start]]), axis=1) if len(chunk.of_run) else np.zeros((2, 0), np.int64)
    rows = np.minimum(np.bincount(once[0], minlength=len(chunk.anchors)), 65535).astype("<u2")
    order, bucket = chunk.by_bucket(buckets)
    planes = chunk.anchors[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT]
    out = []
    for low, high in _groups(bucket):
        out.append((name, 0, int(bucket[low]), high - low, planes[low:high].T.tobytes(), rows[order[low:high]].tobytes()))
    return _sent(out)


def _groups(keys: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of equal keys."""
    if not len(keys):
        return []
    edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    return list(zip(edges, edges[1:], strict=False))


def _shared(table: pa.Table, common: int) -> pa.Table:
    """For each chunk of a bucket, which of its anchors two rows have, and which more than `common`."""
    rows = _received(table)
    values, counts = [], []
    for _, _, _, n, a, b in rows:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :SENT] = np.frombuffer(a, np.uint8).reshape(SENT, n).T
        values.append(wide.view("<u8").ravel())
        counts.append(np.frombuffer(b, "<u2"))
    _, back = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate(counts))
    found = np.split(total[back], np.cumsum([r[3] for r in rows])[:-1])
    return _sent([(r[0], 0, r[2], r[3], np.packbits(t > 1).tobytes(), np.packbits(t > common).tobytes()) for r, t in zip(rows, found, strict=True)])


def _stretches(table: pa.Table, answers: pa.Table, buckets: int, shards: int) -> pa.Table:
    """For each shard, the chunk's distinct stretches and the least and largest id of each."""
    chunk = Chunk(table)
    found = chunk.stretches(*chunk.flags([(p, a, b) for _, _, p, _, a, b in _received(answers)], buckets), shards)
    owner = chunk.owner[chunk.row[found.start]]
    least, most = np.full(len(found.texts), np.iinfo(np.int64).max), np.full(len(found.texts), np.iinfo(np.int64).min)
    np.minimum.at(least, found.of, owner)
    np.maximum.at(most, found.of, owner)
    name, out = table.column("chunk")[0].as_py(), []
    for shard, part in found.by_shard():
        texts = b"\n".join([found.texts[k] for k in part.tolist()])
        out.append((name, 1, shard, len(part), _packed(texts), _packed(np.stack([least[part], most[part] - least[part]]).tobytes())))
    return _sent(out)


def _verdicts(table: pa.Table) -> pa.Table:
    """For each chunk of a shard, the least document of each window of each of its stretches, in their order."""
    rows = _received(table)
    number: dict[bytes, int] = {}
    texts = [_unpacked(r[4]).split(b"\n") for r in rows]
    of = [np.fromiter((number.setdefault(t, len(number)) for t in some), np.int64, len(some)) for some in texts]
    del texts
    ids = [np.frombuffer(_unpacked(r[5]), np.int64).reshape(2, -1) for r in rows]
    least, most = np.full(len(number), np.iinfo(np.int64).max), np.full(len(number), np.iinfo(np.int64).min)
    for at, (low, above) in zip(of, ids, strict=True):
        np.minimum.at(least, at, low)
        np.maximum.at(most, at, low + above)
    parts = [t.split(b" ") for t in number]
    number.clear()
    found = matched_minimum(parts, least, WINDOW)
    del parts
    return _sent([(r[0], 1, r[2], r[3], _packed(np.concatenate([found[k] for k in at.tolist()]).tobytes()), b"") for r, at in zip(rows, of, strict=True)])


def _judged(table: pa.Table, answers: pa.Table, buckets: int, shards: int) -> tuple[Chunk, list[list[tuple[int, int]]]]:
    """The chunk and, for each of its rows in order, the disjoint removed intervals of words."""
    chunk, rows = Chunk(table), _received(answers)
    found = chunk.stretches(*chunk.flags([(p, a, b) for _, k, p, _, a, b in rows if k == 0], buckets), shards)
    verdicts = {p: np.frombuffer(_unpacked(a), np.int64) for _, k, p, _, a, _ in rows if k == 1}
    spans: list[list[tuple[int, int]]] = [[] for _ in chunk.order]
    if not found.texts:
        return chunk, spans
    # The verdicts of all distinct stretches end to end; `place` is where each one's windows begin.
    place, flat, done = np.zeros(len(found.texts), np.int64), [], 0
    for shard, part in found.by_shard():
        n = found.windows[part]
        place[part] = done + np.cumsum(n) - n
        flat.append(verdicts[shard])
        done += int(n.sum())
    flat = np.concatenate(flat)
    steps = np.arange(int(found.length.sum())) - np.repeat(np.cumsum(found.length) - found.length, found.length)
    window = np.repeat(found.start, found.length) + steps
    gone = window[flat[np.repeat(place[found.of], found.length) + steps] < chunk.owner[chunk.row[window]]]
    depth = np.zeros(len(chunk.hashes) + WINDOW, np.int32)
    np.add.at(depth, gone, 1)
    np.add.at(depth, gone + WINDOW, -1)
    covered = np.cumsum(depth)[: len(chunk.hashes)] > 0
    for k in np.unique(chunk.row[gone]).tolist():
        row, first = chunk.judged[k], chunk.first[k]
        mine = np.zeros(chunk.size[row] + 2, np.int8)
        mine[1:-1] = covered[first : first + chunk.size[row]]
        edges = np.flatnonzero(np.diff(mine)).tolist()
        spans[row] = list(zip(edges[::2], edges[1::2], strict=True))
    return chunk, spans


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>"


def _kept(table: pa.Table, answers: pa.Table, buckets: int, shards: int) -> pa.Table:
    chunk, spans = _judged(table, answers, buckets, shards)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    removed, digests = [], []
    for text, gone in zip(chunk.texts, spans, strict=True):
        if gone:
            ws = text.split(b" ")
            edges = [0, *(x for s in gone for x in s), len(ws)]
            text = b" ".join([w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in ws[a:b]])
        removed.append(sum(b - a for a, b in gone))
        digests.append(hashlib.sha256(text).hexdigest())
    columns = [
        table.column("doc_id").take(pa.array(chunk.order, pa.int64())),
        pa.array(chunk.size, pa.int64()),
        pa.array(removed, pa.int64()),
        pa.array(digests, pa.string()),
        pa.array([[{"start": a, "end": b} for a, b in gone] for gone in spans], kind),
    ]
    return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])


def _cut(table: pa.Table, answers: pa.Table, buckets: int, shards: int) -> pa.Table:
    """Texts without their removed words; white space between kept words stays as it is."""
    chunk, spans = _judged(table, answers, buckets, shards)
    order = pa.array(chunk.order, pa.int64())
    texts = table.column("text").take(order).to_pylist()
    for k, gone in enumerate(spans):
        if gone:
            raw = chunk.raw[k]
            edges = [m.span() for m in _WORD.finditer(raw)]
            bounds = [0, *(x for a, b in gone for x in (edges[a][0], edges[b][0] if b < len(edges) else len(raw))), len(raw)]
            texts[k] = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)).strip().decode()
    return pa.table([pa.array(texts, pa.string()), table.column("rest").take(order)], names=["text", "rest"])


def _removal(docs: DataFrame, keep: list[str], finish, schema) -> DataFrame:
    """`finish` applied to every chunk and the answers to it; `keep`: columns it gets as the struct `rest`."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets, shards = (1 + n_bytes // size for size in (CHUNK_BYTES, BUCKET_BYTES, SHARD_BYTES))
    rest = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest")] if keep else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text", *rest)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)))
    common, by_chunk = COMMON, rows.groupBy("chunk")
    anchors = by_chunk.applyInArrow(lambda texts: _anchors(texts, buckets), _SENT)
    shared = anchors.groupBy("part").applyInArrow(lambda sent: _shared(sent, common), _SENT)
    stretches = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(lambda texts, bits: _stretches(texts, bits, buckets, shards), _SENT)
    verdicts = stretches.groupBy("part").applyInArrow(_verdicts, _SENT)
    answers = shared.union(verdicts).groupBy("chunk")
    return by_chunk.cogroup(answers).applyInArrow(lambda texts, got: finish(texts, got, buckets, shards), schema)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed intervals (word positions) of every row."""
    return _removal(docs, [], _kept, _OUT)


def cut_texts(docs: DataFrame) -> DataFrame:
    """`docs` with the removed words cut from `text`; documents of which nothing is left are dropped."""
    keep = [c for c in docs.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "text string, rest struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in keep) + ">"
    found = _removal(docs, keep, _cut, schema)
    columns = [F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return found.select(*columns).filter(F.col("text").rlike(WORD))
