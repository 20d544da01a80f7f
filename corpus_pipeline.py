"""The corpus pipeline: quality rules, near duplicates, repeated substrings, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the shared
checkpoint folder, reads it again as the next stage's documents, and deletes the folder before it.

Defined cases, by row and whatever further columns the rows have (they pass through all stages but the
last, also where their names are those of an operator's columns):
- a null or empty text fails the quality rules, so it goes in the first stage;
- rows with a null id are judged by the rules, are never near duplicates, neither lose words nor cause
  removal, and are mixed and packed like any other;
- of rows repeated with one id and text one stays; rows of one id with different texts are documents of
  their own; of a near-duplicate class the least id stays, at equal ids the least text hash;
- very long texts are read whole by every stage and only packing cuts them;
- an empty table gives an empty table at every stage, with its columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.llm import mixing, ngram_join, packing, quality_rules, substring_dedup
from pulsefield.llm.common import shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_documents(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one with the least id."""
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a document with a smaller id has already; emptied ones go."""
    return substring_dedup.cut_texts(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by target weights; a document taken twice is there twice."""
    return mixing.taken_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the mix with its sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: SQL cannot express tokens and sequences; tests hold `run` against a brute-force version.
ORACLE_SQL = None


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = _written(stage(spark, docs, sf_dir), f"{base}/{k}")
        if k:
            _delete(spark, f"{base}/{k - 1}")
    return docs
