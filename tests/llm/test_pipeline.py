import zlib

import corpus_pipeline
import numpy as np
import pytest
from brute import dedup, near

from pulsefield.llm import mixing, packing, quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline._written(stage(spark, docs, sf), str(tmp_path / str(k)))
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if k < 4:
            assert out.columns == COLUMNS, name
            after = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
        if k == 0:
            kept = {r.doc_id for r in quality_rules.apply_rules(docs).collect() if r.kept}
            assert sorted(after) == sorted(r for r in before if r[0] in kept) and len(kept) < len(before)
        elif k == 1:
            assert {i for i, _ in after} == {c for _, c, _ in near(before)}
        elif k == 2:
            left = {i: n - gone for i, n, gone, _ in dedup(before)}
            assert {i: len(t.split()) for i, t in after} == {i: n for i, n in left.items() if n}
        elif k == 3:
            taken = {r.doc_id: r.taken for r in mixing.mix(mixing.sizes(docs)).collect()}
            words = {}
            for i, t in after:
                words[i] = words.get(i, 0) + len(t.encode().split())
            assert words == {i: n for i, n in taken.items() if n}
        else:
            tok, want = packing.tokenizer(), []
            for i, t in before:
                ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
                want += [(i, s // 4096, zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for s in range(0, len(ids), 4096)]
            assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in out.collect()) == sorted(want)
        docs = out


CLASHING = "tie row first stays n_words kept rest copy slot key size chunk part _row".split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Texts that pass the rules, with nulls, repeated rows and ids, ties, and columns named as the operators name theirs."""
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"{w} the" for w in rng.choice([f"word{k}" for k in range(5000)], n))
    one, other = text(60), text(60)
    near, passage = one.replace("the", "and", 1), text(30)
    texts = [(1, one), (5, near), (5, other), (1, one), (7, one), (None, one), (None, one), (2, None), (3, ""), (8, text(4000))]
    texts += [(10, text(40) + " " + passage), (11, passage + " " + text(40)), (11, text(50)), (12, "too short")]
    rows = [(i, t, None if k % 3 else "en", f"s{k % 2}" if k % 5 else None, len(t or ""), *[1000 + k] * len(CLASHING)) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} long" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


def test_stages_work_by_rows_and_keep_other_columns(spark, clashing):
    docs = clashing
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before, out = docs.collect(), stage(spark, docs, "")
        assert out.columns == clashing.columns, name
        after = out.collect()
        # The clashing columns still say which row of the input a row comes from.
        assert all({r[c] for c in CLASHING} == {r.tie} for r in after), name
        ids = sorted((r.tie - 1000, r.doc_id) for r in after)
        if k == 0:
            assert [i for _, i in ids] == [1, 5, 5, 1, 7, None, None, 8, 10, 11, 11]
        elif k == 1:
            assert sorted(i for _, i in ids if i is not None) == [1, 5, 8, 10, 11, 11] and [i for _, i in ids].count(None) == 2
            assert (2, 5) in ids and (1, 5) not in ids
        elif k == 2:
            want = {(r.tie, n - gone) for r, (_, n, gone, _) in zip(before, dedup([(r.doc_id, r.text) for r in before]), strict=True) if n > gone}
            assert {(r.tie, len(r.text.split())) for r in after} == want
        docs = spark.createDataFrame(after, clashing.schema)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_stages_of_nothing(spark, clashing):
    docs = clashing.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_run_deletes_what_its_stages_wrote(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: str(tmp_path))
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [p.name for p in next(tmp_path.glob("pipeline-*")).iterdir()] == ["4"]


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns[:2] == ["doc_id", "piece"]
