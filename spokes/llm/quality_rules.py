"""Quality rules with adaptive thresholds (native DataFrame functions only).

Base rules are fixed. Beyond them a document's four features are held against
limits drawn from mergeable quantile sketches per language and source:

* ``symbols``   symbols per 1000 characters of words
* ``dup_lines`` repeated lines per 1000 lines with a word
* ``repeats``   words in repeated 5-word windows per 1000 words
* ``length``    tenths of characters per word

A sketch is the set of (bin, count) of a feature, whose bins are the integers
above; two sketches merge by adding counts, so partial sketches are made before
the shuffle and a hot source costs one row per bin and task. It is exact at that
resolution and the same for any order of rows. Limits are outlier fences:
q75 + FENCE * (q75 - q25) + slack, and for ``length`` the mirror image below.
A (language, source) cell of fewer than MIN_CELL documents takes the merged
sketch of its language, a language below that the merged sketch of all.

Defined cases: very long texts: whole, and a document is one row; null text: no words, so the base rules reject it; null language or
source: a cell of its own; repeated rows: each is judged; ties: quantiles are the
smallest bin whose cumulative share reaches the level; empty table: no rows;
other columns are ignored by :func:`features` and kept by :func:`stage`.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokes.llm._text import words
from spokes.storage import save

#: Characters counted as symbols, the window, and the base limits.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW, MIN_WORDS, MAX_REPEAT = 5, 10, 20

#: Parameters of the adaptive limits.
MIN_CELL = 50
FENCE = 4
SLACK = {"symbols": 30, "dup_lines": 400, "repeats": 140, "length": 15}
FEATURES = tuple(SLACK)


def repeat_words(w: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the array ``w``.

    Hashes only clear arrays without a repeat; where two hashes are equal, the
    windows' words themselves are sorted and compared. O(n log n) in any case.
    """
    n = F.size(w)
    starts = F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    clear = F.size(F.array_distinct(hashes)) == F.size(hashes)
    by_words = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("w"), i.alias("i"))))

    def twice(s: Column) -> Column:
        m = F.size(s)
        return F.array_sort(
            F.transform(
                F.filter(
                    F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(s, k - 1)["w"] == x["w"]).eqNullSafe(True) | (F.when(k + 1 < m, F.get(s, k + 1)["w"]) == x["w"]).eqNullSafe(True)).alias("two"))),
                    lambda x: x["two"],
                ),
                lambda x: x["i"],
            )
        )

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    one = lambda value, then: F.aggregate(F.array(value), F.lit(0), lambda _, x: then(x))  # noqa: E731  names a value once
    return F.when((n < WINDOW + 1) | clear, 0).otherwise(one(by_words, lambda s: one(twice(s), covered)))


def features(docs: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, lang, source, base counts, base_failed and the four features; ``keep`` adds columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = keep or {}
    split = docs.select(
        "doc_id",
        "lang",
        "source",
        *(c.alias(k) for k, c in keep.items()),
        words(F.col("text")).alias("_words"),
        F.length(F.translate(text, WHITE, "")).alias("_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "").alias("_lines"),
    )
    counted = split.select(
        "doc_id",
        "lang",
        "source",
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )
    share = lambda a, times, b: F.expr(f"{a} * {times} div greatest({b}, 1)")
    return counted.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", 1000, "word_chars").alias("symbols"),
        share("n_dup_lines", 1000, "n_lines").alias("dup_lines"),
        share("n_repeat_words", 1000, "n_words").alias("repeats"),
        share("word_chars", 10, "n_words").alias("length"),
    )


def sketches(scored: DataFrame) -> DataFrame:
    """Rows: lang, source, feature, bin, n. Documents that failed the base rules don't count."""
    long = scored.where(~F.col("base_failed")).select(
        "lang", "source", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES))).alias("x")
    )
    return long.select("lang", "source", "x.*").groupBy("lang", "source", "feature", "bin").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """Rows: lang, source, low_<feature>, high_<feature>, from each cell's own or nearest merged sketch."""
    by_lang = sketch.groupBy("lang", "feature", "bin").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("feature", "bin").agg(F.sum("n").alias("n"))

    def quartiles(bins: DataFrame, keys: list[str]) -> DataFrame:
        over = Window.partitionBy(*keys, "feature")
        run = bins.select("*", F.sum("n").over(over.orderBy("bin")).alias("upto"), F.sum("n").over(over).alias("total"))
        level = lambda p: F.min(F.when(F.col("upto") * 4 >= F.col("total") * p, F.col("bin")))
        return run.groupBy(*keys, "feature").agg(F.max("total").alias("total"), level(1).alias("q1"), level(3).alias("q3"))

    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(by_lang, ["lang"]).select(F.col("lang").alias("l"), F.col("feature").alias("lf"), F.struct("total", "q1", "q3").alias("by_lang"))
    every = quartiles(by_all, []).select(F.col("feature").alias("af"), F.struct("total", "q1", "q3").alias("by_all"))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("feature") == F.col("lf"))).join(every, F.col("feature") == F.col("af"))
    pick = F.when(F.col("total") >= MIN_CELL, F.struct("total", "q1", "q3")).when(F.col("by_lang.total") >= MIN_CELL, F.col("by_lang")).otherwise(F.col("by_all"))
    slack = reduce(lambda c, f: c.when(F.col("feature") == f, SLACK[f]), FEATURES, F)
    limits = both.select("lang", "source", "feature", pick.alias("p"), slack.alias("slack")).select(
        "lang",
        "source",
        "feature",
        (F.col("p.q3") + FENCE * (F.col("p.q3") - F.col("p.q1")) + F.col("slack")).alias("high"),
        (F.col("p.q1") - FENCE * (F.col("p.q3") - F.col("p.q1")) - F.col("slack")).alias("low"),
    )
    of = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    return limits.groupBy("lang", "source").agg(*(of(f, "high").alias(f"high_{f}") for f in FEATURES), of("length", "low").alias("low_length"))


def judge(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """``scored`` with ``kept``: within the base rules and every limit of its cell.

    A cell whose documents all failed the base rules has no limits; nothing in it is kept.
    """
    cells = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = scored.join(cells, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = reduce(and_, [F.col(f) <= F.col(f"high_{f}") for f in FEATURES], F.col("length") >= F.col("low_length"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its counts, base_failed and kept."""
    scored = save(features(docs), "quality")
    return judge(scored, thresholds(sketches(scored)))


def stage(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, with all their columns."""
    scored = save(features(docs, {"_row": F.struct(*(F.col(f"`{c}`") for c in docs.columns))}), "quality")
    limits = thresholds(sketches(scored.drop("_row")))
    return judge(scored, limits).where("kept").select("_row.*")
