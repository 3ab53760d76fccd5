"""Corpus pipeline: quality rules, near copies, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spokes.llm import byte_bpe, decontaminate, jaccard_join, quality_rules, secret_scan
from spokes.llm.q04 import ranks
from spokes.llm.q_tokens import vocabulary
from spokes.storage import release, save


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the limits of their language and source."""
    return quality_rules.stage(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one of the least doc_id."""
    return jaccard_join.stage(docs)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    return secret_scan.stage(docs, vocabulary("word_bpe_49k.json"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their count, and the hashes of the ids and of the decoded bytes."""
    return byte_bpe.encode_with_digest(docs, ranks(), keep_ids=True)


STAGES = [
    ("quality_rules", keep_good),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", keep_clean_of_benchmark),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: SQL can't express the merges of the last stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
