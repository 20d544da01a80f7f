import tempfile
import uuid
from pathlib import Path

import numpy as np
import pytest
from brute import dedup, near

from pulsefield.llm import fm_index, ngram_join, substring_dedup
from pulsefield.llm.components import connected_components


def key(r):
    return tuple((x is None, x) for x in r)


def test_fm_index_counts_patterns():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = fm_index.FMIndex(text, 4, 13, np.zeros(len(text), np.int64))
    s = text.tolist()
    for at in range(0, 380, 7):
        low, high = np.array([0]), np.array([len(s)])
        pattern = s[at : at + 9]
        for c in reversed(pattern):
            low, high = index.extend(np.array([c]), low, high)
        assert high[0] - low[0] == sum(s[k : k + 9] == pattern for k in range(len(s)))


def test_matched_minimum_finds_the_least_owner():
    parts = [[f"w{k % 9}" for k in range(a, a + 20)] for a in (0, 9, 3, 100)] + [[f"q{k}" for k in range(13)]]
    owner = np.array([7, 5, 6, 4, 3])
    found = fm_index.matched_minimum(parts, owner, 13)
    for p, f in zip(parts, found, strict=True):
        for k, m in enumerate(f):
            w = p[k : k + 13]
            assert m == min(o for q, o in zip(parts, owner, strict=True) if any(q[j : j + 13] == w for j in range(len(q) - 12)))


def test_dedup_of_odd_rows(odd, rows):
    got = sorted((tuple(r)[:4] for r in substring_dedup.dedup(odd).collect()), key=key)
    assert got == sorted(dedup([(r[0], r[1]) for r in rows]), key=key)


def test_dedup_of_the_corpus(spark, corpus):
    df = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in substring_dedup.dedup(df).collect()) == sorted(dedup([(i, t) for i, t, _ in corpus]))


def test_common_anchors_are_dealt_by_windows(spark, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "COMMON", 2)
    some = [(i, t) for i, t, _ in corpus[:120]]
    df = spark.createDataFrame(some, "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in substring_dedup.dedup(df).collect()) == sorted(dedup(some))


def test_dedup_of_nothing(none):
    assert substring_dedup.dedup(none).count() == 0
    assert substring_dedup.cut_texts(none).count() == 0


def test_cut_texts_keeps_white_space(spark):
    p = " ".join(f"p{k}" for k in range(15))
    df = spark.createDataFrame([(1, p, "x"), (2, f"a\n\nb  {p}\tc d", "y"), (3, p, "z")], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in substring_dedup.cut_texts(df).collect()}
    assert got == {1: p, 2: "a\n\nb  c d"}


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    assert [ngram_join.least_matches(n) for n in (16, 150)] == sorted(ngram_join.least_matches(n) for n in (16, 150))
    assert 0 < ngram_join.least_matches(150) < 120


def test_join_of_odd_rows(odd, rows):
    got = sorted((tuple(r) for r in ngram_join.join(odd).collect()), key=key)
    assert got == sorted(near([(r[0], r[1]) for r in rows]), key=key)


@pytest.mark.parametrize("block", [512, 3])
def test_join_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = [f"word{k}" for k in range(200)]
    texts = []
    for k in range(25):
        w = list(base)
        for at in rng.integers(0, 200, k % 6):
            w[at] = f"new{k}at{at}"
        texts.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate(texts + [texts[0], "apart from them all", ""])]
    got = sorted(tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(near(rows))


def test_join_of_a_chain_goes_to_few_tiles(spark, monkeypatch):
    """Each text is like its neighbours only, so one component holds texts that are nothing alike."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    count = ngram_join._verify
    rows = [(k, " ".join(f"word{at}" for at in range(12 * k, 12 * k + 200))) for k in range(90)]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def verify(table):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(table.num_rows))
        return count(table)

    monkeypatch.setattr(ngram_join, "_verify", verify)
    got = sorted(tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(near(rows))
    assert {c for _, c, _ in got} == {0}
    copied = sum(int(p.read_text()) for p in Path(folder).iterdir())
    assert 90 <= copied < 90 * 30 / 2  # 30 blocks: all pairs of blocks would take 30 copies of each


def test_join_of_the_corpus(spark, corpus):
    rows = [(i, t) for i, t, _ in corpus]
    got = sorted(tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(near(rows))


def test_join_of_nothing(none):
    assert ngram_join.join(none).count() == 0
