"""The corpus pipeline: from raw documents to packed training sequences, five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import decontaminate, linededup, minhash, packing, quality
from memlake.llm.common import checkpoint_folder, small_broadcast, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_ROWS = 200_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject. It is trained on the labelled documents of the input."""
    return quality.kept(docs.select(*COLUMNS), quality.trained(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that an earlier line matches; all documents stay, n_chars follows the text. Repeated rows become
    one, and rows that share a doc_id without sharing a text stay apart by their texts."""
    return linededup.with_deduped_text(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least doc_id; where none has any, one of its texts."""
    others = minhash.later_copies(docs).select(F.col("doc_id").alias("other_id"), F.col("mark").alias("other_mark"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("other_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("other_mark"))
    return docs.select(*COLUMNS).join(small_broadcast(others, BROADCAST_ROWS), same, "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as packed token pieces."""
    return packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokeniser have no SQL; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
