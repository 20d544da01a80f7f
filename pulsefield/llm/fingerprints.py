"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraph digests.

A text is cut into passages: at every line end, and inside a line after content-defined words (so an
edit disturbs its own passage only). Each passage has a 64-bit digest; equal passages of one text get
different digests by their occurrence number, so the digests form a set. The sketch hashes each digest
into three cells, each a count, the xor of digests and the xor of their check hashes.

Two sketches of one size subtract cell by cell; common digests cancel, and peeling cells that hold a
single digest recovers the difference. If peeling stalls, both texts are sketched again with four times
the cells, until it succeeds. From the difference d of sets of a and b digests, the common part is
(a + b - d) / 2 and the likeness is common / (common + d). The work of a whole batch of texts is
vectorised: the cells of all its pairs lie in one array.

`compare` streams the table in descending doc_id order and needs no window over the whole table: ids
fall into buckets by quantiles, one bucket is one task, sorted and streamed, and the first row of each
bucket is sent also to the bucket above, where it follows the last row.

Defined cases: null texts count as empty; two texts without words have equal sketches and likeness 1; a
text without words and one with words have likeness 0; rows of one id are ordered by a hash of the
text; a single row is its own next document; an empty table gives an empty result; other columns are
never read. Rows with a null id come last in the order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefield.llm.common import shuffle_partitions

#: Cells of the first and smallest sketch (three equal parts); each retry has GROW times as many.
CELLS, GROW = 24, 4
#: A passage ends, on average, after so many words.
PASSAGE = 8
CODES = 400_000
#: Texts compared at once; bounds a task's memory besides its Arrow batch.
BLOCK = 256
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ _U(salt)) * _MULT
        x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return x ^ (x >> _U(32))


class Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < CODES:
            self[word] = code
        return code


#: A Python worker keeps its table from task to task.
_CODES = Codes()


def _lines(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and the places of the last word of each line that has one."""
    lines = [line.split() for line in text.split(b"\n")]
    return [w for line in lines for w in line], np.cumsum([len(line) for line in lines if line]) - 1


def _hashes(ws: list[bytes], codes: Codes) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, ws), _U, len(ws))


def digests(text: bytes, codes: Codes) -> np.ndarray:
    """The distinct passage digests of a text."""
    ws, ends = _lines(text)
    return _digests(_hashes(ws, codes), ends)


def _edited_hashes(text: str, following: str, h: np.ndarray, h_next: np.ndarray, ws: list[bytes], codes: Codes) -> np.ndarray:
    """Word hashes of the edited text (its words are `ws`): those of its two sources, but where they were cut or meet."""
    half = len(text) // 2
    before, after = len(text[: len(text) - half].encode().split()), len(following[:half].encode().split())
    head, tail = max(before - 1, 0), max(after - 2, 0)
    middle = len(ws) - 1 - tail
    if len(ws) < 2 or middle < head:
        return _hashes(ws, codes)
    return np.concatenate([h[:head], _hashes(ws[head:middle], codes), h_next[1 : 1 + tail], _hashes(ws[-1:], codes)])


def _digests(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        pair = _mix(h + np.concatenate([[_U(0)], h[:-1]]) * _U(3), 0x51ED)
    last = pair % _U(PASSAGE) == 0
    last[ends] = True
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    at = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    d = _mix(np.add.reduceat(_mix(h, 1) * (_mix(at.astype(_U), 2) | _U(1)), starts), 3)
    order = np.argsort(d, kind="stable")
    s = d[order]
    run = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
    nth = np.arange(len(s)) - np.repeat(run, np.diff(np.append(run, len(s))))
    return np.where(nth == 0, s, _mix(s + nth.astype(_U) * _MULT, 4))


def _places(d: np.ndarray, part: np.ndarray | int) -> list[np.ndarray]:
    return [(_mix(d, 11 + k) % np.asarray(part, _U) + _U(k) * np.asarray(part, _U)).astype(np.int64) for k in range(3)]


def sketch(d: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """count, key and check of each cell."""
    count, key, check = np.zeros(cells, np.int64), np.zeros(cells, _U), np.zeros(cells, _U)
    for at in _places(d, cells // 3):
        np.add.at(count, at, 1)
        np.bitwise_xor.at(key, at, d)
        np.bitwise_xor.at(check, at, _mix(d, 99))
    return count, key, check


def fingerprint(d: np.ndarray) -> str:
    """The smallest sketch and the number of digests as text."""
    count, key, check = sketch(d)
    raw = np.array([len(d)], "<u4").tobytes() + count.astype("<u4").tobytes() + key.astype("<u8").tobytes() + (check & _U(0xFFFFFFFF)).astype("<u4").tobytes()
    return base64.b64encode(raw).decode()


def differences(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list[int]]:
    """The digests in which each pair differs, recovered by peeling, and the cells that took."""
    out: list[np.ndarray] = [np.zeros(0, _U)] * len(pairs)
    took = [CELLS] * len(pairs)
    left, cells = list(range(len(pairs))), CELLS
    while left:
        part = cells // 3
        d = np.concatenate([x for i in left for x in pairs[i]])
        sign = np.concatenate([np.full(len(x), s) for i in left for x, s in zip(pairs[i], (1, -1), strict=True)]).astype(np.int64)
        base = np.repeat(np.arange(len(left)) * cells, [len(pairs[i][0]) + len(pairs[i][1]) for i in left])
        count, key, check = np.zeros(len(left) * cells, np.int64), np.zeros(len(left) * cells, _U), np.zeros(len(left) * cells, _U)
        mark = _mix(d, 99)
        for at in _places(d, part):
            np.add.at(count, base + at, sign)
            np.bitwise_xor.at(key, base + at, d)
            np.bitwise_xor.at(check, base + at, mark)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ask = np.flatnonzero(np.abs(count) == 1)
        while len(ask):
            pure = ask[(np.abs(count[ask]) == 1) & (check[ask] == _mix(key[ask], 99))]
            if not len(pure):
                break
            owner, k = pure // cells, key[pure]
            _, one = np.unique(k + owner.astype(_U) * _MULT, return_index=True)
            owner, k, s = owner[one], k[one], count[pure[one]]
            found.append((owner, k))
            touched = []
            for at in _places(k, part):
                at = owner * cells + at
                np.add.at(count, at, -s)
                np.bitwise_xor.at(key, at, k)
                np.bitwise_xor.at(check, at, _mix(k, 99))
                touched.append(at)
            ask = np.unique(np.concatenate(touched))
        dirty = np.zeros(len(left), bool)
        dirty[np.flatnonzero((count != 0) | (key != 0)) // cells] = True
        if found:
            owner, k = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(left) + 1))
            for j, i in enumerate(left):
                out[i] = k[order[cuts[j] : cuts[j + 1]]]
        for j, i in enumerate(left):
            took[i] = cells
        left, cells = [i for j, i in enumerate(left) if dirty[j]], cells * GROW
    return out, took


def likeness(a: int, b: int, d: int) -> float:
    common = (a + b - d) / 2
    return common / (common + d) if common + d else 1.0


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by as many first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cells_edited long, cells_next long, passages long"


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is compared with the next row of its bucket."""
    codes, last, block = _CODES, None, []

    def flush() -> pa.RecordBatch:
        rows, pairs, sizes = [], [], []
        for (doc_id, text, h, a), (following, h_next, b) in block:
            raw = edited(text, following).encode()
            ws, ends = _lines(raw)
            e = _digests(_edited_hashes(text, following, h, h_next, ws, codes), ends)
            pairs += [(a, e), (a, b)]
            sizes += [(len(a), len(e)), (len(a), len(b))]
            rows.append([doc_id, len(text), hashlib.sha256(raw).hexdigest(), fingerprint(a), fingerprint(e)])
        found, took = differences(pairs)
        for k, row in enumerate(rows):
            row += [likeness(*sizes[2 * k + j], len(found[2 * k + j])) for j in (0, 1)] + [took[2 * k], took[2 * k + 1], sizes[2 * k][0]]
        block.clear()
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        columns = (batch.column(c).to_pylist() for c in ("bucket", "ghost", "doc_id", "text"))
        for bucket, ghost, doc_id, text in zip(*columns, strict=True):
            text = text or ""
            ws, ends = _lines(text.encode())
            h = _hashes(ws, codes)
            d = _digests(h, ends)
            if last is not None and last[0] == bucket:
                block.append((last[1], (text, h, d)))
                if len(block) >= BLOCK:
                    yield flush()
            last = None if ghost else (bucket, (doc_id, text, h, d))
    if block:
        yield flush()


def compare(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text, and the likenesses to that and to the next text."""
    rows = docs.select("doc_id", "text")
    n = buckets or 2 * shuffle_partitions(docs)
    # Some hundreds of numbers: where to cut the ids, so that each bucket has about as many rows.
    at = sorted(set(rows.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)), reverse=True) if n > 1 else []
    # Bucket 0 has the largest ids; null ids come last.
    cuts = F.array(*[F.lit(x) for x in at]) if at else F.array().cast("array<double>")
    below = F.size(F.filter(cuts, lambda c: c >= F.col("doc_id")))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(at) + 1)).otherwise(below)
    placed = rows.withColumns({"bucket": bucket, "tie": F.xxhash64(F.coalesce("text", F.lit("")))})
    first = F.min(F.struct((-F.col("doc_id")).alias("o"), "tie"))
    heads = sorted(placed.groupBy("bucket").agg(first.alias("first")).collect())  # a row for each bucket
    if not heads:
        at_end = []
    else:
        at_end = [(h.bucket, h.first.tie, None if h.first.o is None else -h.first.o, heads[k - 1].bucket) for k, h in enumerate(heads)]
    ghosts = docs.sparkSession.createDataFrame(at_end, "bucket int, tie long, head long, above int")
    is_head = (placed["bucket"] == ghosts["bucket"]) & (placed["tie"] == ghosts["tie"]) & placed["doc_id"].eqNullSafe(ghosts["head"])
    sent = placed.join(F.broadcast(ghosts), is_head, "left").select(placed["doc_id"], "text", placed["tie"], placed["bucket"], "above")
    to = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost")), F.struct(F.col("above").alias("bucket"), F.lit(True).alias("ghost")))
    dealt = sent.select("doc_id", "text", "tie", F.inline(F.filter(to, lambda x: x["bucket"].isNotNull())))
    ordered = dealt.repartitionById(len(at) + 2, F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), "tie")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ordered.select("bucket", "ghost", "doc_id", "text").mapInArrow(_follow, _SCHEMA.format(kind=kind))
