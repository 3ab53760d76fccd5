"""Command line (O05, O91, O94, O95): ``python -m spokes.plans.cli``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from spokes.plans import pipeline, render
from spokes.plans.config import load_config
from spokes.sources.extractors import HttpChatExtractor, RuleExtractor
from spokes.sources.files import export_json, json_path, read_text, read_triples
from spokes.sources.seeds import sample_triples


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Build and view a graph of triples")
    p.add_argument("--input", help="a text file or folder")
    p.add_argument("--triples", help="a JSON array of triples to view again")
    p.add_argument("--output", default="graph.html")
    p.add_argument("--config", default="config.toml")
    p.add_argument("--rules", action="store_true", help="extract by rules, without a model")
    p.add_argument("--test", action="store_true", help="view the sample")
    p.add_argument("--no-standardize", action="store_true")
    p.add_argument("--no-inference", action="store_true")
    p.add_argument("--debug", action="store_true", help="print the answers and what was read from them")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("spokes").getOrCreate()
    if a.triples:
        try:
            print(render.render(read_triples(spark, a.triples), a.output))
        except Exception as e:  # noqa: BLE001  reported to the shell
            print(f"failed: {e}")
            return 1
        return 0
    config = load_config(a.config)
    if config is None:
        print(f"can't read {a.config}")
        return 0
    if a.test:
        print(render.render(sample_triples(spark), a.output, config.edge_smooth))
        return 0
    if not a.input:
        p.error("--input is needed")
    extractor = RuleExtractor() if a.rules else HttpChatExtractor(config.base_url, config.model, config.api_key, config.max_tokens, config.temperature)
    try:
        docs = read_text(spark, a.input)
        docs.isEmpty()
    except Exception as e:  # noqa: BLE001
        print(f"can't read {a.input}: {e}")
        return 0
    result = pipeline.run(docs, extractor, config.without(a.no_standardize, a.no_inference))
    if a.debug:
        for r in result.answers.orderBy("request").toLocalIterator():
            print(f"--- {r.request} ({r.stage or r.error or 'unread'})\n{r.response}\n=== {r.value}")
    if result.triples.isEmpty():
        print("no triples were found")
        return 0
    result.report.show(1000, truncate=False)
    export_json(result.triples, json_path(a.output))
    print(render.render(result.triples, a.output, config.edge_smooth))
    return 0


if __name__ == "__main__":
    sys.exit(main())
