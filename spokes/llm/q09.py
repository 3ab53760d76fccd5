"""op9: perplexity and verdict of all documents under a model of trusted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spokes.llm import kneser_ney
from spokes.llm._text import table


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
