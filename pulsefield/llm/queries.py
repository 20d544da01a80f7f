"""The registered queries of the operators: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.llm import chat, conversation_repair, exact_dedup, fingerprints, licenses, mixing, ngram_join, packing, prefix_trie, quality_classifier, quality_rules, substring_dedup, toxicity
from pulsefield.llm.common import documents, id_bucket, labelled_sample, labels


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("removed").alias("n_spans"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), id_bucket("doc_id", 3) == 1
    sample = labelled_sample(labels(spark, sf_dir), "quality", ~held_out, quality_classifier.SAMPLE)
    scored = quality_classifier.score(docs, quality_classifier.train(docs, sample))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sizes(documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_shouted"
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), id_bucket("doc_id", 5) == 0
    sample = labelled_sample(labels(spark, sf_dir), "toxic", ~held_out, toxicity.SAMPLE)
    scored = toxicity.score(docs, toxicity.train(docs, sample))
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
        F.coalesce(F.aggregate("passages", F.lit(0), lambda a, p: a + p["end"] - p["start"]), F.lit(0)).alias("n_toxic_words"),
    )


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.array_min(F.transform("spans", lambda s: s["place"])).alias("first_sentence"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.repair(rows, F.col("gone"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    conv = F.col("conv_id")
    return prefix_trie.trie(prefix_trie.with_shared_starts(turns, conv - conv % 5, id_bucket("conv_id", 9), prefix_trie.BORROWED))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_mixing_sources": op4_mixing_sources,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op9_toxicity": op9_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op10_license_scans": op10_license_scans,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_exact_dedup": op13_exact_dedup,
}
