"""Text to graph (O87-O91): chunk, ask, read answers, standardize, infer, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokes.functions.jsonx import array_items, ladder, mapping_rows
from spokes.functions.text import chunks
from spokes.operators import infer as I
from spokes.operators import resolve as R
from spokes.operators import triples as T
from spokes.plans import prompts
from spokes.plans.config import Config
from spokes.schema import BETWEEN, SEQ, WITHIN
from spokes.sources.extractors import Extractor
from spokes.storage import save

PARTS = "subject", "predicate", "object"


def read_answers(answers: DataFrame) -> DataFrame:
    """``answers`` with kind, value and stage of the response's JSON; empty values count as failures."""
    read = answers.withColumn("j", ladder(F.col("response"))).select(*answers.columns, "j.kind", "j.value", "j.stage")
    return read.where("kind IS NOT NULL AND value NOT IN ('[]', '{}', '0', '\"\"', 'false', 'null')")


def extract(pieces: DataFrame, extractor: Extractor) -> tuple[DataFrame, DataFrame]:
    """(triples, failures) of chunk rows (doc_id, chunk, text)."""
    return extract_counted(pieces, extractor)[:2]


def extract_counted(pieces: DataFrame, extractor: Extractor) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(triples, failures, dropped, answers) of chunk rows (doc_id, chunk, text).

    Answers are saved first: they are the one costly step that can't be repeated.
    A failed call is a row of ``failures``; a caller that must abort looks there.
    ``dropped`` has one row per item of an answer that is no triple; ``answers`` are
    as they came, with the kind, value and stage of what was read from them.
    """
    asked = pieces.select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("request"),
        F.lit(prompts.EXTRACT_SYSTEM).alias("system"),
        prompts.extract(F.col("text")).alias("user"),
    )
    answers = save(extractor.run(asked), "answers")
    read = read_answers(answers).where("kind = 'array'").withColumn("at", F.split("request", ":"))
    every = array_items(read.selectExpr("CAST(at[0] AS BIGINT) AS doc_id", "CAST(at[1] AS INT) AS chunk", "value"))
    items = T.valid_items(every)
    dropped = every.select("doc_id", "chunk", "pos").join(items.select("doc_id", "chunk", "pos"), ["doc_id", "chunk", "pos"], "left_anti")
    seq = F.struct(F.lit(0).alias("phase"), F.col("doc_id").alias("doc"), "chunk", F.col("pos").cast("bigint").alias("pos"))
    rows = items.select(*PARTS, "chunk", F.lit(False).alias("inferred"), seq.cast(SEQ).alias("seq"))
    done = items.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("request")).distinct()
    failed = answers.join(done, "request", "left_anti").select("request", F.coalesce("error", F.lit("no triples in the answer")).alias("error"))
    told = answers.withColumn("j", ladder(F.col("response"))).select(*answers.columns, "j.kind", "j.value", "j.stage")
    return T.with_short_predicates(rows), failed, dropped, told


def resolve_by_model(extractor: Extractor):
    """A step for :func:`resolve.standardize`; a failure leaves the triples as they are."""

    def step(triples: DataFrame) -> DataFrame:
        names = T.top_entities(triples, 100).agg(F.collect_list("entity").alias("names")).where(F.size("names") > 0)
        asked = names.select(F.lit("entities").alias("request"), F.lit(prompts.ENTITIES_SYSTEM).alias("system"), prompts.entities(F.col("names")).alias("user"))
        answers = read_answers(save(extractor.run(asked), "answers")).where("kind = 'object'")
        return R.apply_model_mapping(triples, save(mapping_rows(answers), "mapping"))

    return step


def _line():
    return F.concat_ws(" ", *PARTS)


def between_requests(triples: DataFrame, components: DataFrame) -> DataFrame:
    """At most ten requests, of pairs of the five largest components."""
    top = save(I.top_components(components, 5), "top")
    names = I.component_members(components, top, 5)
    listed = names.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("names"))
    pairs = I.component_pairs(top).select(F.format_string("between:%02d:%02d", "r1", "r2").alias("request"), "c1", "c2")
    both = pairs.join(listed.select(F.col("component").alias("c1"), F.col("names").alias("n1")), "c1").join(listed.select(F.col("component").alias("c2"), F.col("names").alias("n2")), "c2")
    wanted = both.select("request", F.explode(F.concat("n1", "n2")).alias("entity"))
    lines = I.context(triples, wanted).groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", _line().alias("l")))), lambda x: x["l"]).alias("lines"))
    full = both.join(lines, "request", "left")
    return full.select("request", F.lit(prompts.BETWEEN_SYSTEM).alias("system"), prompts.between(F.col("n1"), F.col("n2"), F.coalesce("lines", F.array())).alias("user"))


def within_requests(triples: DataFrame, components: DataFrame) -> DataFrame:
    """At most three requests, of the three largest components with five nodes or more."""
    top = save(I.top_components(components, 3, 5), "top")
    pairs = save(I.within_pairs(components, top, triples), "pairs")
    labelled = pairs.select(F.concat(F.lit("within:"), "component").alias("request"), "a", "b", "k")
    lines = I.context(triples, labelled.select("request", F.explode(F.array("a", "b")).alias("entity")))
    facts = lines.groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", _line().alias("l")))), lambda x: x["l"]).alias("lines"))
    asked = labelled.groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" and ", "a", "b").alias("p")))), lambda x: x["p"]).alias("pairs"))
    full = asked.join(facts, "request", "left")
    return full.select("request", F.lit(prompts.WITHIN_SYSTEM).alias("system"), prompts.within(F.col("pairs"), F.coalesce("lines", F.array())).alias("user"))


def _proposed(requests: DataFrame, extractor: Extractor, phase: int) -> DataFrame:
    read = read_answers(save(extractor.run(requests), "answers")).where("kind = 'array'")
    items = T.valid_items(array_items(read.select("request", "value")))
    rows = T.without_self_loops(items.select("request", "pos", *PARTS))
    return T.with_short_predicates(T.tagged(rows, phase, "request", "pos"))


def infer_by_model(extractor: Extractor):
    """O89 and O90 as a step for :func:`infer.infer`."""

    def step(triples: DataFrame, components: DataFrame) -> DataFrame:
        kept = save(components, "components")
        return T.append(_proposed(between_requests(triples, kept), extractor, BETWEEN), _proposed(within_requests(triples, kept), extractor, WITHIN))

    return step


@dataclass
class Result:
    triples: DataFrame
    failures: DataFrame
    report: DataFrame
    answers: DataFrame


def _top(df: DataFrame, phase: str, when: str) -> DataFrame:
    """The five most frequent predicates."""
    return T.top_predicates(df).select(F.lit(phase).alias("phase"), F.concat(F.lit(f"{when}: "), "predicate").alias("metric"), F.col("n").alias("value"))


def _metric(df: DataFrame, phase: str, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("value")).select(F.lit(phase).alias("phase"), F.lit(name).alias("metric"), "value")


def run(docs: DataFrame, extractor: Extractor, config: Config | None = None) -> Result:
    """Documents (doc_id, text) to triples, with a report of every phase (O12). Phases end in saved tables."""
    config = config or Config()
    raw, failures, dropped, answers = extract_counted(chunks(docs, config.chunk_size, config.overlap), extractor)
    rows = save(raw, "extracted")
    report = [_metric(rows, "extract", "triples"), _metric(T.unique_entities(rows), "extract", "entities")]
    report += [_metric(dropped, "extract", "dropped: not a triple"), _metric(failures, "extract", "failed requests")]
    if config.standardize:
        before, rows = rows, save(R.standardize(rows, resolve_by_model(extractor) if config.model_for_entities else None), "standardized")
        loops = before.join(rows.select("seq"), "seq", "left_anti")
        report += [_metric(loops, "standardize", "dropped: of one entity alone")]
        report += [_metric(rows, "standardize", "triples"), _metric(T.unique_entities(rows), "standardize", "entities")]
    if config.infer:
        ask = infer_by_model(extractor) if config.model_for_inference else None
        report += [_metric(I.saved_components(rows).select("component").distinct(), "infer", "components"), _top(rows, "infer", "before")]
        rows = save(I.infer(rows, ask), "inferred")
        report += [_top(rows, "infer", "after")]
        report += [_metric(rows, "infer", "triples"), _metric(rows.where("inferred"), "infer", "inferred")]
    return Result(rows, failures, T.append(*report), answers)
