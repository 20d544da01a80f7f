"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal updates.

Features are counts of hashed n-grams: words, pairs of words, word shapes and pairs of shapes (a shape
writes letters as A or a and digits as 0), plus the count of pairs seen before in the same text. Each
family is scaled to sqrt(count / total). A text's score is the sparse dot product of its features and
the weights, through the logistic function.

Training takes a sample of at most about `SAMPLE` labelled rows (the documented bound), dealt by hash
over `SHARDS` groups; each group runs follow-the-regularised-leader over its rows in an order fixed by
hash, and the groups' weights are averaged. The model has 2^`BITS` weights at most, which is the bound
on what is broadcast.

Defined cases: a null text counts as empty; an empty text gets the score of the bias and its length;
rows without an id or label are not learnt from; repeated rows are scored one by one; an empty table,
or one without labels, gives score 0.5 for what there is to score; very long texts are read whole;
other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
SAMPLE = 24_000
SHARDS = 8
PASSES = 3
#: FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: Words kept in a task's table of codes before it starts anew.
CODES = 200_000
_SEEN, _LENGTH = 7, 64


class Codes(dict):
    """Word (bytes) to a hash of the word, 32 bits, and one of its shape, 31 bits, in one integer."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "0", "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in text)))
        code = zlib.crc32(word.lower()) | (zlib.crc32(shape.encode()) >> 1) << 32
        if len(self) < CODES:
            self[word] = code
        return code


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: bytes | None, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Indices (each once) and values of a text's features; index 0 is the bias."""
    ws = (text or b"").split()
    code = np.fromiter(map(codes.__getitem__, ws), np.int64, len(ws)).astype(np.uint64)
    word, shape = code & np.uint64(0xFFFFFFFF), code >> np.uint64(32)
    found = [(np.array([0, _LENGTH + len(ws).bit_length()]), np.ones(2))]
    if len(ws):
        same = (word[1:] == word[:-1]).astype(np.uint64)
        pairs = _mixed(word[:-1], word[1:], 2)
        for ids in (_mixed(word, word, 1), pairs, _mixed(shape, shape, 3), _mixed(shape[:-1], shape[1:] + same, 4)):
            if len(ids):
                one, n = np.unique(ids, return_counts=True)
                found.append((one, np.sqrt(n / len(ids))))
                if ids is pairs:
                    found.append((np.array([_SEEN]), np.array([1 - len(one) / len(ids)])))
    at, x = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    one, back = np.unique(at, return_inverse=True)
    return one, np.bincount(back, weights=x)


def _ftrl(table: pa.Table) -> pa.Table:
    codes, z, n = Codes(), np.zeros(1 << BITS), np.zeros(1 << BITS)
    texts = table.column("text").cast(pa.binary()).to_pylist()
    order = sorted(range(len(texts)), key=lambda k: zlib.crc32(str(table.column("doc_id")[k].as_py()).encode()))
    rows = [(*features(texts[k], codes), table.column("label")[k].as_py()) for k in order]

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(PASSES):
        for at, x, y in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(1 << BITS))
    at = np.flatnonzero(w)
    return pa.table({"feature": pa.array(at, pa.int32()), "w": pa.array(w[at], pa.float64())})


def train(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """The averaged weights. sample: doc_id, label (see labelled_sample)."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)))
    fitted = rows.groupBy("shard").applyInArrow(_ftrl, "feature int, w double").groupBy("feature").agg(F.sum("w").alias("w"))
    model = np.zeros(1 << BITS, np.float32)
    got = fitted.toPandas()  # 2^BITS rows at most
    model[got["feature"].to_numpy(np.int64)] = got["w"].to_numpy(np.float64) / SHARDS
    return model


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    codes, w = Codes(), model.value.astype(np.float64)
    for batch in batches:
        logit = np.empty(batch.num_rows)
        for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            at, x = features(text, codes)
            logit[k] = w[at] @ x
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id and score, 0 to 1, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_score, model=shared), f"doc_id {kind}, score double")
