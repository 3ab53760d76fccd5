"""op4: all documents encoded by the ranks of a byte-level BPE, and decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spokes.llm import byte_bpe
from spokes.llm._text import table


def ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_with_digest(table(spark, sf_dir, "documents"), ranks())
