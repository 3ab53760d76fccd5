"""Inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spokes.functions.text import limit_predicate, words
from spokes.operators.components import connected_components
from spokes.operators.triples import append, dedupe, edges, last_predicate, tagged, unique_entities, with_short_predicates, without_self_loops
from spokes.schema import LEXICAL, TRANSITIVE
from spokes.storage import save


def transitive(triples: DataFrame) -> DataFrame:
    """One row per path a-b-c without an edge a-c; the predicate names b unless both steps agree."""
    steps = last_predicate(triples)
    first = steps.select(F.col("subject").alias("a"), F.col("predicate").alias("p1"), F.col("object").alias("mid"))
    second = steps.select(F.col("subject").alias("mid"), F.col("predicate").alias("p2"), F.col("object").alias("c"))
    direct = edges(triples).select(F.col("src").alias("a"), F.col("dst").alias("c"))
    paths = first.join(second, "mid").where("a <> c").join(direct, ["a", "c"], "left_anti")
    said = F.when(F.col("p1") == F.col("p2"), F.concat(F.lit("indirectly "), "p1")).otherwise(F.concat("p1", F.lit(" via "), "mid"))
    return tagged(paths.select(F.col("a").alias("subject"), limit_predicate(said).alias("predicate"), F.col("c").alias("object"), "mid"), TRANSITIVE, "mid")


def shared_word_pairs(names: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, word): pairs a < b of ``names`` that share a lower-case word of ``least`` characters, with the longest, least such word.

    An equi-join on words; pairs without one are never made.
    """
    each = names.select("entity", F.explode(F.array_distinct(words(F.lower("entity")))).alias("word")).where(F.length("word") >= least)
    both = each.select(F.col("entity").alias("a"), "word").join(each.select(F.col("entity").alias("b"), "word"), "word").where("a < b")
    return both.groupBy("a", "b").agg(F.min(F.struct((-F.length("word")).alias("k"), "word"))["word"].alias("word"))


def containment_pairs(names: DataFrame) -> DataFrame:
    """(outer, inner): the lower-case name of inner lies in that of outer.

    Substrings of the lengths that names have are joined with names by equality, so
    the work is that of the substrings and no pair is tried in vain.
    """
    low = names.select("entity", F.lower("entity").alias("low"))
    sizes = sorted(r.n for r in low.select(F.length("low").alias("n")).distinct().collect())  # no more than the longest name has characters
    if not sizes:
        return names.select(F.col("entity").alias("outer"), F.col("entity").alias("inner"))
    fit = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("low"))
    cut = F.flatten(F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda i: F.substring("low", i, n))))
    parts = low.select(F.col("entity").alias("outer"), F.explode(F.array_distinct(cut)).alias("low"))
    return parts.join(low.select(F.col("entity").alias("inner"), "low"), "low").where("outer <> inner").select("outer", "inner")


def lexical(names: DataFrame, triples: DataFrame) -> DataFrame:
    """Relations by shared words of four characters or more, or by containment of names without a shared word."""
    linked = edges(triples).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    shared = shared_word_pairs(names, 4).join(linked, ["a", "b"], "left_anti")
    starts = lambda c: F.lower(c).startswith(F.col("word"))
    one = starts("a") != starts("b")
    by_word = shared.select(
        F.when(one & starts("a"), F.col("b")).otherwise(F.col("a")).alias("subject"),
        F.when(one, "relates to").otherwise("related to").alias("predicate"),
        F.when(one & starts("a"), F.col("a")).otherwise(F.col("b")).alias("object"),
    )
    held = containment_pairs(names).select(F.least("outer", "inner").alias("a"), F.greatest("outer", "inner").alias("b"), "outer", "inner")
    apart = ~F.arrays_overlap(words(F.lower("outer")), words(F.lower("inner")))
    # Of equal lower-case names, each holds the other; the larger text is the outer one.
    once = (F.lower("outer") != F.lower("inner")) | (F.col("outer") > F.col("inner"))
    by_part = held.where(apart & once).join(linked, ["a", "b"], "left_anti").select(F.col("outer").alias("subject"), F.lit("is type of").alias("predicate"), F.col("inner").alias("object"))
    return tagged(by_word.unionByName(by_part), LEXICAL)


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def top_components(components: DataFrame, most: int = 5, least_size: int = 1) -> DataFrame:
    """(component, size, rank) by size, then label; small ones are dropped after the cut."""
    top = component_sizes(components).orderBy(F.desc("size"), "component").limit(most)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "component")))
    return ranked.where(F.col("size") >= least_size)


def component_pairs(top: DataFrame) -> DataFrame:
    """(c1, c2) of at most five components; at most ten rows."""
    a = top.select(F.col("component").alias("c1"), F.col("rank").alias("r1"), F.lit(1).alias("k"))
    b = top.select(F.col("component").alias("c2"), F.col("rank").alias("r2"), F.lit(1).alias("k"))
    return a.join(b, "k").where("r1 < r2").select("c1", "c2", "r1", "r2")


def component_members(components: DataFrame, top: DataFrame, most: int = 5) -> DataFrame:
    """(component, node, k): the first ``most`` nodes of each."""
    over = Window.partitionBy("component").orderBy("node")
    return components.join(top.select("component"), "component", "left_semi").withColumn("k", F.row_number().over(over)).where(F.col("k") <= most)


def within_pairs(components: DataFrame, top: DataFrame, triples: DataFrame, most: int = 10) -> DataFrame:
    """Per component the first ordered pairs without an edge a-b whose names share a word or lie in each other."""
    own = components.join(top.select("component"), "component", "left_semi")
    names = own.select(F.col("node").alias("entity"))
    alike = shared_word_pairs(names).select("a", "b").union(containment_pairs(names).select(F.col("outer").alias("a"), F.col("inner").alias("b")))
    both = alike.union(alike.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    a = own.select(F.col("node").alias("a"), "component")
    b = own.select(F.col("node").alias("b"), F.col("component").alias("c2"))
    same = both.join(a, "a").join(b, "b").where("component = c2").drop("c2")
    free = same.join(edges(triples).select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    over = Window.partitionBy("component").orderBy("a", "b")
    return free.withColumn("k", F.row_number().over(over)).where(F.col("k") <= most).select("component", "a", "b", "k")


def context(triples: DataFrame, wanted: DataFrame, most: int = 20) -> DataFrame:
    """Per ``request`` of ``wanted`` (request, entity) its first triples that touch an entity."""
    at = triples.select("subject", "predicate", "object", "seq", F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"))
    hits = at.join(wanted.select("request", "entity").distinct(), "entity").select("request", "subject", "predicate", "object", "seq").distinct()
    over = Window.partitionBy("request").orderBy("seq", "subject", "predicate", "object")
    return hits.withColumn("k", F.row_number().over(over)).where(F.col("k") <= most)


def infer(triples: DataFrame, ask=None, apply_transitive: bool = True) -> DataFrame:
    """Original rows and what follows from them, deduplicated, with short predicates and no self-loops.

    Fewer than two rows come back as they are. ``ask(triples, components)`` is an
    optional step that returns more triples (O89, O90); transitive steps see them.
    """
    if triples.limit(2).count() < 2:
        return triples
    names = unique_entities(triples)
    rows = append(triples, ask(triples, connected_components(edges(triples)))) if ask else triples
    parts = [rows] + ([transitive(triples)] if apply_transitive else []) + [lexical(names, triples)]
    return without_self_loops(with_short_predicates(dedupe(append(*parts))))


def saved_components(triples: DataFrame) -> DataFrame:
    return save(connected_components(edges(triples)), "components")
