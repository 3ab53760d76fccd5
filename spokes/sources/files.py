"""File sources and sinks."""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokes.schema import SEQ


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text), one row per file; ids follow the paths."""
    from pyspark.sql import Window

    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return files.select(F.row_number().over(Window.orderBy("path")).cast("bigint").alias("doc_id"), "text")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of a JSON array file, in its order."""
    text = spark.read.text(path, wholetext=True).select(F.expr("from_json(value, 'array<struct<subject string, predicate string, object string, chunk int, inferred boolean>>')").alias("t"))
    rows = text.select(F.posexplode("t").alias("pos", "t")).select("t.*", "pos")
    seq = F.struct(F.lit(0).alias("phase"), F.lit(0).cast("bigint").alias("doc"), F.coalesce("chunk", F.lit(0)).alias("chunk"), F.col("pos").cast("bigint").alias("pos"))
    return rows.select("subject", "predicate", "object", "chunk", F.coalesce("inferred", F.lit(False)).alias("inferred"), seq.cast(SEQ).alias("seq"))


def write_triples(triples: DataFrame, path: str) -> None:
    """Distributed sink: Parquet, whatever the size."""
    triples.write.mode("overwrite").parquet(path)


def export_json(triples: DataFrame, path: str, most: int = 1_000_000) -> int:
    """One pretty, ASCII-escaped array; for results that fit the driver, checked first. Returns the number of rows."""
    rows = triples.orderBy("seq").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} triples: use write_triples")
    out = []
    for r in rows:
        item = {"subject": r.subject, "predicate": r.predicate, "object": r.object}
        item |= {"inferred": True} if r.inferred else {"chunk": r.chunk}
        out.append(item)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2)
    return len(out)


def json_path(html_path: str) -> str:
    return html_path.replace(".html", ".json")


def template(name: str = "graph.html") -> str:
    """A packaged page, or a bare element if there is none."""
    try:
        return resources.files("spokes.plans").joinpath(name).read_text(encoding="utf-8")
    except (FileNotFoundError, ModuleNotFoundError):
        return "<main></main>"
