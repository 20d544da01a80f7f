import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsefield.llm import quality_classifier, toxicity
from pulsefield.llm.common import id_bucket, labelled_sample
from pulsefield.llm.queries import QUERIES


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op3_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = scored[scored.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert scored.score.between(0, 1).all()


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = scored[scored.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held[held.toxic == 1].predicted.mean() > 0.85


def test_scores_of_odd_rows_and_of_none(spark, odd, none, rows):
    labels = spark.createDataFrame([(0, 1), (1, 0), (5, 1), (6, 0), (None, 1), (7, None), (0, 1)], "doc_id long, label int")
    sample = labelled_sample(labels, "label", id_bucket("doc_id", 3) != 7, 100)
    assert sorted(r.doc_id for r in sample.collect()) == [0, 1, 5, 6]
    for op in (quality_classifier, toxicity):
        model = op.train(odd, sample)
        got = op.score(odd, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        empty = op.train(none, labels.limit(0))
        assert op.score(none, empty).count() == 0
        assert {r.score for r in op.score(odd, empty).collect()} == {0.5}


def test_segments_equal_brute_force():
    """All maximal segments: the best one first, then the best of what lies on either side of it."""

    def brute(s, offset=0):
        best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        a, b = best[3], best[4]
        return brute(s[:a], offset) + [(a + offset, b + offset, best[0])] + brute(s[b:], offset + b)

    rng = np.random.default_rng(5)
    for _ in range(200):
        s = rng.normal(size=rng.integers(1, 25)).round(3)
        got = [(a, b, round(x, 6)) for a, b, x in toxicity.segments(s)]
        assert got == [(a, b, round(float(x), 6)) for a, b, x in brute(s.tolist())]


def test_updates_equal_plain_follow_the_regularised_leader():
    """FTRL-proximal a coordinate at a time, in dictionaries."""
    q = quality_classifier
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice(["good", "fine", "###", "1234", "Words", "bad"], int(rng.integers(0, 12)))), int(rng.integers(0, 2))) for k in range(40)]
    got = q._ftrl(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "label": [r[2] for r in rows]})).to_pydict()
    z, n, codes = {}, {}, q.Codes()

    def weight(i):
        if abs(z.get(i, 0.0)) <= q.L1:
            return 0.0
        return -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(q.PASSES):
        for _, text, label in sorted(rows, key=lambda r: zlib.crc32(str(r[0]).encode())):
            x = dict(zip(*(v.tolist() for v in q.features(text.encode(), codes)), strict=True))
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g, before = (p - label) * v, n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / q.ALPHA * w[i]
    want = {i: weight(i) for i in z if weight(i)}
    assert got["feature"] == sorted(want)
    np.testing.assert_allclose(got["w"], [want[i] for i in sorted(want)], rtol=1e-9)


def test_shapes_are_whole():
    codes = quality_classifier.Codes()
    long = "aB1" * 10
    assert codes[long.encode()] >> 32 != codes[(long + "#").encode()] >> 32


def test_features_are_sparse_and_scaled():
    at, x = quality_classifier.features(b"a b a b ### A1", quality_classifier.Codes())
    assert len(at) == len(set(at.tolist())) and (x > 0).all() and at.max() < 1 << quality_classifier.BITS
    at, _ = quality_classifier.features(None, quality_classifier.Codes())
    assert len(at) == 2


def test_folds_follow_the_crc(spark):
    got = spark.range(50).select("id", id_bucket(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)
