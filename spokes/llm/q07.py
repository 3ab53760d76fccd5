"""op7: classes and links of all documents by 5-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spokes.llm import jaccard_join
from spokes.llm._text import table


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))
