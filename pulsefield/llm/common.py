"""Words, lineage cuts and column hygiene shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def words(text: str | Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_bucket(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`: the fold of a document."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; there is no other to fall back on."""
    folder = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")  # one machine: tests and benchmarks
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of `df` in the folder that all executors share."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with a caller's columns of these names (in any case) renamed, and how to name them back."""
    taken = {c.lower() for c in docs.columns}
    moved = {}
    for c in docs.columns:
        if c.lower() in names:
            other = f"{c}_aside"
            while other.lower() in taken:
                other += "_"
            taken.add(other.lower())
            moved[c] = other
    return docs.withColumnsRenamed(moved), {v: k for k, v in moved.items()}


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(table: DataFrame, column: str, keep: Column, bound: int) -> DataFrame:
    """doc_id, label of about `bound` labelled rows at most, picked by a hash of the id.

    `keep` is a condition on doc_id that names the rows which may be learnt from. Rows of one id
    count once (the larger label); null ids and labels are left out. The size is bounded in
    expectation, whatever the size of the table, so the result can be broadcast.
    """
    rows = table.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & keep)
    rows = rows.groupBy("doc_id").agg(F.max(F.col(column)).cast("int").alias("label"))
    share = min(1.0, bound / max(1, table.count()))
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


#: Keys that `attach` broadcasts at most.
HEAVY = 1000


def attach(rows: DataFrame, stats: DataFrame, keys: list[str], size: str, total: int, spread: Column) -> DataFrame:
    """`rows` with the columns of their key's row in `stats` (null where there is none); no key burdens a task.

    `stats` has one row per key and the number of rows with that key, `size`; these add up to `total` at most.
    Keys of more than total / HEAVY rows are fewer than HEAVY, and are broadcast. The other keys are joined by a
    shuffle, in which the rows that are served already are dealt by `spread`, an integer.
    """
    names = [c for c in stats.columns if c not in keys]
    packed = stats.select(*keys, F.struct(*names).alias("_found"))
    many = F.col("_found")[size] > max(1, total // HEAVY)
    heavy = F.broadcast(packed.filter(many).withColumnRenamed("_found", "_heavy"))
    light = packed.filter(~many).withColumnRenamed("_found", "_light").withColumn("_dealt", F.least(F.col("_light")[size].cast("long"), F.lit(0)))  # 0, but no literal: it must stay a key
    met = rows.join(heavy, keys, "left").withColumn("_dealt", F.when(F.col("_heavy").isNotNull(), 1 + F.abs(spread)).otherwise(0).cast("long"))
    met = met.join(light, [*keys, "_dealt"], "left").withColumn("_found", F.coalesce("_heavy", "_light"))
    return met.select(*rows.columns, *[F.col("_found")[c].alias(c) for c in names])
