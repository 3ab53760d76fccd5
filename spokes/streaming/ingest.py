"""Streaming ingest: documents are chunked and read as they arrive; each batch is appended to a table of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spokes.functions.text import chunks
from spokes.plans.pipeline import extract
from spokes.sources.extractors import Extractor


def stream_triples(docs: DataFrame, extractor: Extractor, path: str, checkpoint: str, size: int = 100, overlap: int = 20) -> StreamingQuery:
    """``docs`` (doc_id, text) is a stream; one folder per batch makes a repeated batch overwrite itself."""

    def each(batch: DataFrame, number: int) -> None:
        rows, failed = extract(chunks(batch, size, overlap), extractor)
        rows.write.mode("overwrite").parquet(f"{path}/triples/batch={number}")
        failed.write.mode("overwrite").parquet(f"{path}/failures/batch={number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
