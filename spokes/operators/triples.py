"""Operators on triples: validity, tags, defaults, sets, counts, dedupe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spokes.functions.text import limit_predicate
from spokes.schema import SEQ


def valid_items(items: DataFrame) -> DataFrame:
    """(subject, predicate, object) of VARIANT ``item`` rows that have all three; scalars become text, nulls are rejected."""
    part = lambda k: F.try_variant_get("item", f"$.{k}", "string").alias(k)
    return items.select("*", part("subject"), part("predicate"), part("object")).where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")


def without_self_loops(triples: DataFrame) -> DataFrame:
    """O15; names are compared with their case."""
    return triples.where("subject <> object")


def with_defaults(triples: DataFrame) -> DataFrame:
    """Chunk 0 and inferred false where they are missing."""
    return triples.withColumns({"chunk": F.coalesce("chunk", F.lit(0)), "inferred": F.coalesce("inferred", F.lit(False))})


def with_short_predicates(triples: DataFrame, most: int = 3) -> DataFrame:
    return triples.withColumn("predicate", limit_predicate(F.col("predicate"), most))


def ends(triples: DataFrame) -> DataFrame:
    """One row per end of a triple: entity, its place in the order of rows (subject before object)."""
    both = F.array(F.struct(F.col("subject").alias("entity"), F.lit(0).alias("side")), F.struct(F.col("object").alias("entity"), F.lit(1).alias("side")))
    return triples.select("seq", F.explode(both).alias("e")).select("e.entity", F.struct("seq", "e.side").alias("at"))


def unique_entities(triples: DataFrame, lower: bool = False) -> DataFrame:
    """O46, O47, O84."""
    e = triples.select(F.explode(F.array("subject", "object")).alias("entity"))
    return e.select(F.lower("entity").alias("entity") if lower else "entity").distinct()


def entity_frequency(triples: DataFrame, lower: bool = False) -> DataFrame:
    """How often an entity is an end; a self-loop counts twice."""
    e = triples.select(F.explode(F.array("subject", "object")).alias("entity"))
    return e.groupBy((F.lower("entity") if lower else F.col("entity")).alias("entity")).agg(F.count("*").alias("n"))


def predicate_histogram(triples: DataFrame) -> DataFrame:
    """O48."""
    return triples.groupBy("predicate").agg(F.count("*").alias("n"))


def top_predicates(triples: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent; of equals, the one that is seen first."""
    return triples.groupBy("predicate").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").limit(most).select("predicate", "n")


def top_entities(triples: DataFrame, most: int = 100) -> DataFrame:
    """By count, then first appearance."""
    e = ends(triples).groupBy("entity").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return e.orderBy(F.desc("n"), "first").limit(most).select("entity", "n")


def last_predicate(triples: DataFrame) -> DataFrame:
    """Per (subject, object), the predicate of the last row."""
    return triples.groupBy("subject", "object").agg(F.max_by("predicate", "seq").alias("predicate"))


def edges(triples: DataFrame) -> DataFrame:
    """Distinct (src, dst)."""
    return triples.select(F.col("subject").alias("src"), F.col("object").alias("dst")).distinct()


def undirected_edges(triples: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller name first."""
    return triples.select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).distinct()


def display_edges(triples: DataFrame) -> DataFrame:
    """One row per ordered pair, with the attributes of its last row."""
    last = F.max_by(F.struct("predicate", F.coalesce("inferred", F.lit(False)).alias("inferred")), "seq").alias("x")
    return triples.groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(last).select("src", "dst", F.col("x.predicate").alias("label"), "x.inferred")


def dedupe(triples: DataFrame) -> DataFrame:
    """Per (subject, predicate, object) the last original row or else the first inferred one, at the first one's place.

    The choice is made by min/max per key, combined before the shuffle; no group is held.
    """
    row = F.struct("chunk", "inferred")
    flag = F.coalesce("inferred", F.lit(False))
    keyed = triples.groupBy("subject", "predicate", "object").agg(
        F.max_by(F.when(~flag, row), F.when(~flag, F.col("seq"))).alias("original"),
        F.min_by(F.when(flag, row), F.when(flag, F.col("seq"))).alias("inferred_row"),
        F.min("seq").alias("seq"),
    )
    one = F.coalesce("original", "inferred_row")
    return keyed.select("subject", "predicate", "object", one["chunk"].alias("chunk"), one["inferred"].alias("inferred"), "seq")


def append(*parts: DataFrame) -> DataFrame:
    """Bag union; ``seq`` keeps the order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def inferred_count(triples: DataFrame) -> DataFrame:
    """O49."""
    return triples.agg(F.count_if(F.coalesce("inferred", F.lit(False))).alias("n"))


def inferred_pairs(triples: DataFrame) -> DataFrame:
    """Distinct (subject, object) with an inferred row."""
    return triples.where(F.coalesce("inferred", F.lit(False))).select("subject", "object").distinct()


def tagged(rows: DataFrame, phase: int, *order: str) -> DataFrame:
    """Rows (subject, predicate, object) as inferred triples of ``phase``, in ``order`` within their subject."""
    pos = F.row_number().over(Window.partitionBy("subject").orderBy(*order, "object", "predicate")).cast("bigint")
    seq = F.struct(F.lit(phase).alias("phase"), F.lit(0).cast("bigint").alias("doc"), F.lit(0).alias("chunk"), pos.alias("pos"))
    return rows.select("subject", "predicate", "object", F.lit(None).cast("int").alias("chunk"), F.lit(True).alias("inferred"), seq.cast(SEQ).alias("seq"))
