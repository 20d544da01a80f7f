"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

A token's score is its log-odds between toxic and clean text under an informative Dirichlet prior (the
prior follows the token's share of the sample). A word scores by itself where it is significant, else
by the mean of the scores of all its runs of `GRAM` letters, where a run that is not significant counts as the
log-odds of all the rest, which is slightly negative. A linear-time scan (Ruzzo and Tompa) then finds every maximal-scoring segment of a text. Because scores
are log-likelihood ratios, the best segment of n clean words grows as log n; the excess follows a
Gumbel law, fitted to clean rows. A text's evidence is -log of its p-value under that law, and a
one-variable logistic fit turns evidence into a score from 0 to 1.

The log-odds come from about `SAMPLE` labelled rows (the documented bound), three quarters for the
table and one quarter for the calibration. The table keeps every significant token of the sample, so
its size, which is what is broadcast, follows that bound and not the input. Every text is scanned whole,
however long.

Defined cases: a null text counts as empty; a text without a positive token has no segment and the
lowest evidence; repeated rows are scored one by one; without toxic and clean labelled rows every score
is 0.5 and nothing is flagged as a passage; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 40_000
#: Letters in the runs (ends of words are marked) that a word of its own without significance is scored by.
GRAM = 6
#: The Dirichlet prior's weight that follows a token's share, its weight for any token, and the least |z| kept.
PRIOR, FLAT, LEAST_Z = 10.0, 0.5, 3.0
#: A passage is significant where its p-value is at most this.
P_VALUE = 0.001
CODES = 200_000
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def token(word: bytes) -> bytes:
    """A word in lower case without marks at its ends; empty if nothing is left."""
    return _EDGE.sub("", word.decode("utf-8", "replace").lower()).encode()


class Grams(dict):
    """The keys of a token's distinct runs of letters."""

    def __missing__(self, tok: bytes) -> list[bytes]:
        marked = "^" + tok.decode() + "$"
        found = [b"~" + g.encode() for g in dict.fromkeys(marked[k : k + GRAM] for k in range(max(1, len(marked) - GRAM + 1)))] if tok else []
        if len(self) < CODES:
            self[tok] = found
        return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its tokens and runs of letters and their numbers; a row for each of each text."""
    grams = Grams()
    for batch in batches:
        tokens, labels, counts = [], [], []
        for text, toxic in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("label").to_pylist(), strict=True):
            found = Counter()
            for w, n in Counter((text or b"").split()).items():
                found[t := token(w)] += n
                for g in grams[t]:
                    found[g] += n
            found.pop(b"", None)
            tokens += found.keys()
            counts += found.values()
            labels += [toxic] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(labels, pa.int32()), pa.array(counts, pa.int64())], ["token", "label", "n"])


@dataclass(frozen=True)
class Model:
    """scores of tokens, the score of all others; Gumbel place and scale; logistic intercept and slope."""

    scores: dict[bytes, float]
    rest: float
    place: float = 0.0
    scale: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0


class _WordScores(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model, self.grams = model, Grams()

    def __missing__(self, word: bytes) -> float:
        tok, known, rest = token(word), self.model.scores, self.model.rest
        s = known.get(tok)
        if s is None:
            runs = self.grams[tok]
            s = sum(known.get(g, rest) for g in runs) / len(runs) if runs else rest
        if len(self) < CODES:
            self[word] = s
        return s


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a score sequence, in linear time."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # Candidates: start, end, total before, total after, and the nearest earlier candidate with a lower total before.
    kept: list[tuple[int, int, float, float, int]] = []
    for k in np.flatnonzero(scores > 0):
        start, left, right = int(k), total[k], total[k + 1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((start, int(k) + 1, left, right, j))
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, float(r - x)) for a, b, x, r, _ in kept]


def scanned(text: bytes | None, words: _WordScores) -> tuple[int, list[tuple[int, int, float]]]:
    ws = (text or b"").split()
    s = np.fromiter(map(words.__getitem__, ws), np.float64, len(ws))
    return len(ws), segments(s) if len(ws) and s.max() > 0 else []


def excess(n: int, best: float) -> float:
    return best - np.log(max(n, 1))


def evidence(x: np.ndarray, model: Model) -> np.ndarray:
    """-log of the p-value of an excess under the Gumbel law."""
    return -np.log(np.maximum(-np.expm1(-np.exp(-np.clip((x - model.place) / model.scale, -30, 600))), 1e-300))


def _excesses(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    words = _WordScores(model)
    for batch in batches:
        x = []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            n, found = scanned(text, words)
            x.append(excess(n, max((s for _, _, s in found), default=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column("label")], ["x", "label"])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Newton's method with a small ridge."""
    a, b = 0.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(p - y).sum() + 1e-3 * a, ((p - y) * x).sum() + 1e-3 * b])
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(a), float(b)


def train(docs: DataFrame, sample: DataFrame) -> Model:
    """sample: doc_id, label (see labelled_sample)."""
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    fitted = rows.filter(part > 0)
    d1, d0 = fitted.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not d1 or not d0:
        return Model({}, -1.0)
    toxic, clean = F.col("label"), 1 - F.col("label")
    counts = fitted.select("text", "label").mapInArrow(_counts, "token binary, label int, n long")
    by_token = counts.groupBy("token").agg(
        F.sum(F.col("n") * toxic).alias("toxic"), F.sum(F.col("n") * clean).alias("clean"), F.sum(toxic).alias("in_toxic"), F.sum(clean).alias("in_clean")
    ).persist()
    whole = F.substring("token", 1, 1) != F.lit(b"~")
    n1, n0 = (n or 1 for n in by_token.filter(whole).agg(F.sum("toxic"), F.sum("clean")).first())
    # Significance counts texts, so that a word which one text repeats does not stand out; the score counts words.
    prior = lambda both, n: FLAT + PRIOR * both / n
    a = prior(F.col("in_toxic") + F.col("in_clean"), d1 + d0)
    odds = lambda y, n: F.log((y + a) / (n + PRIOR - y))
    z = (odds(F.col("in_toxic"), d1) - odds(F.col("in_clean"), d0)) / F.sqrt(1 / (F.col("in_toxic") + a) + 1 / (F.col("in_clean") + a))
    a = prior(F.col("toxic") + F.col("clean"), n1 + n0)
    ratio = F.log((F.col("toxic") + a) / (n1 + PRIOR)) - F.log((F.col("clean") + a) / (n0 + PRIOR))
    kept = by_token.select("token", "toxic", "clean", z.alias("z"), ratio.alias("s")).filter(F.abs("z") >= LEAST_Z)
    table = kept.orderBy("token").toPandas()  # tokens of a bounded sample
    by_token.unpersist()
    is_word = ~table["token"].map(lambda t: bytes(t).startswith(b"~")).to_numpy(bool) if len(table) else np.zeros(0, bool)
    y1, y0 = float(table["toxic"][is_word].sum()), float(table["clean"][is_word].sum())
    rest = min(-0.005, float(np.log((n1 - y1 + 1) / (n1 + 1)) - np.log((n0 - y0 + 1) / (n0 + 1))))
    model = Model({bytes(t): float(s) for t, s in zip(table["token"], table["s"], strict=True)}, rest)
    fit = rows.filter(part == 0).select("text", "label").mapInArrow(partial(_excesses, model=model), "x double, label int").toPandas()
    x, y = fit["x"].to_numpy(float), fit["label"].to_numpy(float)
    clean = x[y == 0]
    if len(clean) < 2 or not (y == 1).any():
        return model
    scale = max(float(clean.std()) * np.sqrt(6) / np.pi, 1e-3)
    law = Model(model.scores, rest, float(clean.mean()) - 0.5772156649 * scale, scale)
    intercept, slope = _logistic(evidence(x, law), y)
    return Model(law.scores, rest, law.place, law.scale, intercept, max(slope, 0.0))


PASSAGES = "array<struct<start:int,end:int,score:double,p_value:double>>"


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    words = _WordScores(m)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))
    for batch in batches:
        best, passages = np.empty(batch.num_rows), []
        for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            n, found = scanned(text, words)
            best[k] = excess(n, max((s for _, _, s in found), default=0.0))
            p = np.exp(-evidence(np.array([excess(n, s) for _, _, s in found]), m)) if m.slope else np.ones(len(found))
            passages.append([{"start": a, "end": b, "score": s, "p_value": q} for (a, b, s), q in zip(found, p.tolist(), strict=True) if q <= P_VALUE])
        score = 1 / (1 + np.exp(-np.clip(m.intercept + m.slope * evidence(best, m), -40, 40)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and the significant passages (word positions) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_score, model=shared), f"doc_id {kind}, score double, passages {PASSAGES}")
