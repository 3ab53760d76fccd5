"""Entity standardization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokes.functions.text import limit_predicate, normalize, stems, words
from spokes.operators.triples import entity_frequency, without_self_loops
from spokes.storage import save


def variant_groups(triples: DataFrame) -> DataFrame:
    """(norm, variant, n) for lower-case entities; names without a normal form are left out."""
    freq = entity_frequency(triples, lower=True).select(F.col("entity").alias("variant"), "n")
    return freq.select(normalize(F.col("variant")).alias("norm"), "variant", "n").where("norm <> ''")


def representatives(groups: DataFrame) -> DataFrame:
    """(norm, standard): the most frequent variant, then the shortest, then the least; an argmin per key."""
    order = F.struct((-F.col("n")).alias("n"), F.length("variant").alias("size"), "variant")
    return groups.groupBy("norm").agg(F.min(order)["variant"].alias("standard"))


def _position(name: str) -> Column:
    """Order of standard forms: by length, then text."""
    return F.struct(F.length(name).alias("size"), F.col(name).alias("name"))


def subsumption(standards: DataFrame) -> DataFrame:
    """(standard, target) for standard forms that another one takes over.

    For forms x before y in the order of length and text, on their word sets: y goes
    to x if x's words are all in y or the stems of both overlap by more than half of
    the larger stem set; x goes to y instead if only y's words are all in x. A form
    takes the last of its later takers, else the last of its earlier ones. Targets
    aren't followed further.

    No pair is tried that can't hold: a subset is looked up by the rarest of its
    words, and stems are compared once per distinct stem set, after which each form
    takes its predecessor in the order, found by one window per pair of stem sets.
    """
    s = standards.select(F.col("standard").alias("e"), F.array_distinct(words(F.col("standard"))).alias("w"), F.array_sort(stems(F.col("standard"))).alias("st")).dropDuplicates(["e"])
    s = save(s, "standards")  # the vocabulary is read many times below; names are far fewer than triples
    each = s.select("e", F.explode("w").alias("word"))
    rarity = each.groupBy("word").agg(F.count("*").alias("n"))
    rare = each.join(rarity, "word").groupBy("e").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    small = s.join(rare, "e").select(F.col("e").alias("x"), F.col("w").alias("wx"), "word")
    large = s.join(each, "e").select(F.col("e").alias("y"), F.col("w").alias("wy"), "word")
    inside = small.join(large, "word").where((F.col("x") != F.col("y")) & (F.size(F.array_except("wx", "wy")) == 0))
    earlier = _position("x") < _position("y")
    subset = save(inside.select("x", "y", earlier.alias("earlier"), (F.size("wx") == F.size("wy")).alias("same")), "subsets")
    forward = subset.where("earlier").select(F.col("y").alias("e"), F.col("x").alias("to"))
    backward = subset.where("NOT earlier AND NOT same").select(F.col("y").alias("e"), F.col("x").alias("to"))

    sets = s.where(F.size("st") > 0).select("st").distinct()
    by_stem = sets.select("st", F.explode("st").alias("stem"))
    other = by_stem.select(F.col("st").alias("st2"), "stem")
    pairs = by_stem.join(other, "stem").groupBy("st", "st2").agg(F.count("*").alias("both")).where(2 * F.col("both") > F.greatest(F.size("st"), F.size("st2"))).select("st", "st2")
    # Forms that a later one's words lie in can't be taken by it; they are tried one by one.
    barred = backward.select(F.col("to").alias("e"), F.col("e").alias("bar"))
    asks = s.join(pairs, "st").select("st", "st2", "e", F.lit(False).alias("given"))
    gives = s.withColumnRenamed("st", "st2").join(pairs, "st2").select("st", "st2", "e", F.lit(True).alias("given"))
    over = Window.partitionBy("st", "st2").orderBy(F.length("e"), "e", F.col("given")).rowsBetween(Window.unboundedPreceding, -1)
    before = asks.unionByName(gives).withColumn("to", F.last(F.expr("CASE WHEN given THEN e END"), ignorenulls=True).over(over))
    quick = before.where("NOT given AND to IS NOT NULL").select("e", "to").join(barred.select("e").distinct(), "e", "left_anti")
    exact = (
        s.join(barred.select("e").distinct(), "e", "left_semi")
        .join(pairs, "st")
        .select("e", "st2")
        .join(s.select(F.col("e").alias("to"), F.col("st").alias("st2")), "st2")
        .where(_position("to") < _position("e"))
        .select("e", "to")
        .join(barred.withColumnRenamed("bar", "to"), ["e", "to"], "left_anti")
    )
    tries = backward.withColumn("later", F.lit(1)).unionByName(forward.unionByName(quick).unionByName(exact).withColumn("later", F.lit(0)))
    best = F.max(F.struct("later", F.length("to").alias("size"), "to"))["to"].alias("target")
    return tries.groupBy(F.col("e").alias("standard")).agg(best)


def canonical_mapping(triples: DataFrame) -> DataFrame:
    """(variant, standard) of lower-case names; a standard that is taken over changes for its own name alone."""
    groups = save(variant_groups(triples), "variants")
    standards = save(representatives(groups), "representatives")
    base = groups.join(standards, "norm").select("variant", "standard")
    taken = subsumption(standards.select("standard"))
    moved = base.join(taken.withColumnRenamed("standard", "own"), F.col("variant") == F.col("own"), "left")
    return save(moved.select("variant", F.coalesce("target", "standard").alias("standard")), "names")


def rewrite(triples: DataFrame, mapping: DataFrame, lower: bool = True) -> DataFrame:
    """Both ends by the mapping, unmapped names as they are. Spark broadcasts the mapping where its size allows."""
    key = lambda c: F.lower(c) if lower else F.col(c)
    m1 = mapping.select(F.col("variant").alias("v1"), F.col("standard").alias("s1"))
    m2 = mapping.select(F.col("variant").alias("v2"), F.col("standard").alias("s2"))
    joined = triples.join(m1, key("subject") == F.col("v1"), "left").join(m2, key("object") == F.col("v2"), "left")
    return joined.withColumns({"subject": F.coalesce("s1", "subject"), "object": F.coalesce("s2", "object")}).drop("v1", "s1", "v2", "s2")


def apply_model_mapping(triples: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (ord, standard, variants); a later group overwrites an earlier one, each standard names itself last in its group."""
    pairs = rows.select("standard", "ord", F.posexplode(F.concat("variants", F.array("standard"))).alias("k", "variant"))
    last = pairs.groupBy("variant").agg(F.max_by("standard", F.struct("ord", "k")).alias("standard"))
    return rewrite(triples, last, lower=False)


def standardize(triples: DataFrame, ask=None) -> DataFrame:
    """Names by their standards, predicates shortened, chunk 0 where missing, no self-loops.

    ``ask`` is an optional step on the rewritten triples (O88). Other columns and an
    ``inferred`` flag are dropped, as only rows that were read are standardized.
    """
    mapped = rewrite(triples, canonical_mapping(triples))
    out = mapped.select(
        "subject", limit_predicate(F.col("predicate")).alias("predicate"), "object", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.lit(False).alias("inferred"), "seq"
    )
    return without_self_loops(ask(out) if ask else out)
