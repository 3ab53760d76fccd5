"""Text functions as columns (O14, O22-O27); no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokes.schema import NAME_STOPS, TRAILING_STOPS

#: White space of Unicode with the control characters that Python splits at.
SPACES = r"[\s\p{Z}\x0B\x1c-\x1f\x85]+"
#: Word characters in any alphabet; Java's \w knows ASCII alone.
NAME_WORD = r"([\p{L}\p{N}_]+)"


def words(text: Column) -> Column:
    """array<string> without empty words."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def limit_predicate(predicate: Column, most: int = 3) -> Column:
    """At most ``most`` words, then without one trailing stop word; shorter texts are untouched."""
    w = words(predicate)
    head = F.slice(w, 1, most)
    ends_in_stop = F.lower(F.element_at(head, most)).isin(TRAILING_STOPS)
    cut = F.when(ends_in_stop, F.slice(head, 1, most - 1)).otherwise(head)
    return F.when(F.size(w) <= most, predicate).otherwise(F.array_join(cut, " "))


def normalize(name: Column) -> Column:
    """Lower case, words of letters, digits and _, without stop words."""
    found = F.regexp_extract_all(F.lower(name), F.lit(NAME_WORD), F.lit(1))
    return F.array_join(F.filter(found, lambda w: ~w.isin(NAME_STOPS)), " ")


def stems(name: Column) -> Column:
    """Distinct first four characters of words longer than four."""
    return F.array_distinct(F.transform(F.filter(words(name), lambda w: F.length(w) > 4), lambda w: F.substring(w, 1, 4)))


def chunks(docs: DataFrame, size: int = 100, overlap: int = 20) -> DataFrame:
    """(doc_id, chunk from 1, text, n_words) of ``docs`` (doc_id, text).

    A text of at most ``size`` words is one chunk, as it is. Longer ones give
    windows every ``size - overlap`` words, the last window ending at the text's
    end; a closing window may lie within the one before it. Null texts are empty.
    """
    step = size - overlap
    if not 0 <= overlap <= size // 2 or step <= 0:
        raise ValueError(f"overlap {overlap} must lie between 0 and half of the chunk size {size}")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", words(F.col("text")))
    n = F.size("w")
    regular = F.ceil(n / F.lit(step)).cast("int") - 1
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(regular, F.lit(0))),
        lambda k: F.slice("w", F.when(k < regular, k * step).otherwise(F.least(k * step, n - overlap)) + 1, F.when(k < regular, size).otherwise(n)),
    )
    many = F.transform(cut, lambda c: F.struct(F.array_join(c, " ").alias("text"), F.size(c).alias("n_words")))
    one = F.array(F.struct(F.col("text").alias("text"), n.alias("n_words")))
    out = base.select("doc_id", F.posexplode(F.when(n <= size, one).otherwise(many)).alias("k", "c"))
    return out.select("doc_id", (F.col("k") + 1).cast("int").alias("chunk"), "c.text", F.col("c.n_words").cast("int").alias("n_words"))
