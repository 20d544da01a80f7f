import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulsefield.llm import exact_dedup


def plain(rows):
    """(doc_id, keep_id, group_size, kept, sha) of every row, as a multiset."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, first = hashlib.sha256(t.encode()).hexdigest(), True
        for i in ids:
            stays = first and i == keep
            first = first and not stays
            out.append((i, keep, len(ids), stays, sha))
    return Counter(out)


def marked(docs):
    return Counter(tuple(r) for r in exact_dedup.mark(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_odd_rows_equal_the_plain_version(odd, rows):
    assert marked(odd) == plain([(r[0], r[1]) for r in rows])


def test_corpus_equals_the_plain_version(spark, corpus):
    rows = [(i, t) for i, t, _ in corpus] + [(None, corpus[0][1]), (None, None), (-3, "")]
    assert marked(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_empty_table(none):
    assert exact_dedup.mark(none).count() == 0
    assert exact_dedup.kept_documents(none).count() == 0


def test_a_full_filter_gives_the_same_result(spark, corpus, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_WORDS", 1)
    monkeypatch.setattr(exact_dedup, "SEGMENT", 1)
    rows = [(i, t) for i, t, _ in corpus]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert marked(docs) == plain(rows)
    flagged, _ = exact_dedup._filtered(docs, [F.col("doc_id")])
    assert flagged.filter("repeated").count() == len(rows)


def test_the_filter_passes_single_texts_and_keeps_all_repeated_ones(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.greatest(F.col("id"), F.lit(500)).cast("string")).alias("text"))
    flagged, n = exact_dedup._filtered(docs, [F.col("doc_id")])
    assert n == 20_000
    assert flagged.filter("repeated and doc_id <= 500").count() == 501
    assert flagged.filter("repeated and doc_id > 500").count() < 0.05 * 20_000


@pytest.mark.parametrize("copies", [30_000])
def test_a_group_with_most_rows_is_dealt_out(spark, copies):
    docs = spark.range(copies).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.mark(docs)
    assert out.filter("kept").count() == copies // 10 + 1
    hot = out.filter("group_size > 1")
    assert hot.count() == copies * 9 // 10
    assert hot.filter("kept").first()["doc_id"] == copies - 1
    sizes = [r["count"] for r in hot.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.6 * copies


def test_kept_documents_keeps_one_row_of_each_text_with_its_columns(odd, rows):
    kept = exact_dedup.kept_documents(odd)
    assert kept.columns == odd.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter((i, t) for t, i in _largest(rows).items())


def _largest(rows):
    best = {}
    for i, t, *_ in rows:
        t = t or ""
        best[t] = i if best.get(t) is None else best[t] if i is None else max(i, best[t])
    return best
