"""op1, op2 and op8: token counts, token-id files and secret scans over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spokes.llm import secret_scan, token_count, token_store
from spokes.llm._text import table
from spokes.storage import new_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1, folder)
    return token_store.digest(token_store.read(spark, folder))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))
