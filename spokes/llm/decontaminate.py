"""Benchmark decontamination (native DataFrame functions only).

A document leaks an item if a window of it, as many words long as the item, has a
weighted Jaccard similarity of SIMILAR or more with the item over 5-word shingles
(weight: how often the shingle occurs). Words are lower case, without characters
other than letters and digits.

* A window reaches SIMILAR only if so many of its shingles are the item's (weights
  a and b: 4 / 9 of a + b), so fingerprints are taken at all starts of windows that
  hold as many, whatever their order, and at no others.
* Fingerprints are 64-bit SimHashes. An item's 8 blocks of 8 bits are indexed under
  every value within NEAR bits: of two fingerprints within RADIUS = 8 * NEAR + 7
  bits, some block differs by NEAR at most, so the index loses none of them. A pair
  at SIMILAR is expected 10 bits apart with a deviation of 3.
* Candidates within RADIUS are verified by their words, exactly.

The shingles of the items go into the plan as one hashed set if they are at most
MOST_LITERALS (counted first); beyond that they are joined.

Defined cases: null or empty text: no words, no leak; items of fewer than five
words: no shingle, never found; documents shorter than an item: their one window
is the whole document; null doc_id: reported under null; repeated rows: reported
once; rows of one doc_id: each is judged by its own text; very long texts: whole; ties: the first window; empty
tables: no rows; other columns are ignored by :func:`find_leaks` and kept by :func:`stage`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokes.llm._text import words
from spokes.storage import save

SIZE, BITS, BLOCKS, NEAR = 5, 64, 8, 2
RADIUS = BLOCKS * NEAR + BLOCKS - 1
#: SIMILAR as a fraction.
SIMILAR = (4, 5)
MOST_LITERALS = 20_000


def normal(text: Column) -> Column:
    return F.filter(words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]", "")), lambda w: w != "")


def _each_window(w: Column, of) -> Column:
    n = F.size(w) - (SIZE - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: of(F.slice(w, i, SIZE)))).otherwise(F.array())


def shingle_hashes(w: Column) -> Column:
    return _each_window(w, F.xxhash64)


def shingle_words(w: Column) -> Column:
    return _each_window(w, lambda x: F.array_join(x, " "))


def simhash(hashes: str) -> Column:
    """Bit b is set if more of the array ``hashes`` have it than not. One pass carries all the sums."""
    bits = f"sequence(0, {BITS - 1})"
    sums = f"aggregate({hashes}, array_repeat(0, {BITS}), (sums, x) -> zip_with(sums, {bits}, (s, b) -> s + CAST(2 * (shiftright(x, b) & 1L) - 1 AS INT)))"
    return F.expr(f"aggregate(zip_with({sums}, {bits}, (s, b) -> IF(s > 0, shiftleft(1L, b), 0L)), 0L, (fp, v) -> fp | v)")


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, b * (BITS // BLOCKS)).bitwiseAND(F.lit((1 << BITS // BLOCKS) - 1))


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), shingles (hashes), fp."""
    w = benchmark.select("item_id", normal(F.col("text")).alias("w")).where(F.size("w") >= SIZE)
    h = w.select("item_id", "w", F.size("w").alias("n"), shingle_hashes(F.col("w")).alias("shingles"))
    return h.withColumn("fp", simhash("shingles"))


def item_index(items: DataFrame) -> DataFrame:
    """n, block, key, item_id: every value of a block within NEAR bits."""
    width = BITS // BLOCKS
    flips = [f for f in range(1 << width) if f.bit_count() <= NEAR]
    blocks = F.array(*(F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("v")) for b in range(BLOCKS)))
    rows = items.select("item_id", "n", F.explode(blocks).alias("x"))
    return rows.select("item_id", "n", "x.block", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda f: F.col("x.v").bitwiseXOR(f.cast("long")))).alias("key"))


def _uid() -> Column:
    """128 bits of a row's doc_id and text."""
    return F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))))


def _hit_documents(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """uid, doc_id, w, h (hashes), hits (positions) of documents with a shingle of an item."""
    split = docs.select(_uid().alias("uid"), "doc_id", normal(F.col("text")).alias("w"))
    hashed = split.select("uid", "doc_id", "w", shingle_hashes(F.col("w")).alias("h"))
    some = [r.h for r in shingles.select("h").distinct().limit(MOST_LITERALS + 1).collect()]
    if len(some) <= MOST_LITERALS:
        at = F.filter(F.transform("h", lambda x, i: F.when(x.isin(some), i)), lambda i: i.isNotNull())
        # A generator, as a filter would be pushed below the arrays and compute them anew for each element.
        one = F.filter(F.array(F.struct("w", "h", "hits")), lambda x: F.size(x["hits"]) > 0)
        return hashed.withColumn("hits", at).select("uid", "doc_id", F.inline(one))
    hits = hashed.select("uid", F.posexplode("h").alias("pos", "h")).join(shingles.select("h").distinct(), "h", "left_semi")
    return hashed.join(hits.groupBy("uid").agg(F.array_sort(F.collect_set("pos")).alias("hits")), "uid")


def _starts() -> Column:
    """All starts of windows of ``n`` words in a text of ``total`` that hold enough of the sorted positions ``p`` of an item's shingles.

    Any ``need`` positions in a row that fit into one window give the starts from which it holds them.
    """
    weights = F.least("n", "total") + F.col("n") - 2 * (SIZE - 1)
    need = F.ceil(weights * SIMILAR[0] / (SIMILAR[0] + SIMILAR[1])).cast("int")
    ends = F.when(F.size("p") >= need, F.sequence(need, F.size("p"))).otherwise(F.array().cast("array<int>"))
    last = F.greatest(F.lit(0), F.col("total") - F.col("n"))

    def of(k: Column) -> Column:
        lo = F.greatest(F.lit(0), F.element_at("p", k) - (F.col("n") - SIZE))
        hi = F.least(F.element_at("p", k - need + 1), last)
        return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(ends, of)))


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """uid, doc_id, item_id, start, i (weight in common), t (both weights) of all windows that are similar to an item."""
    items = save(item_table(benchmark), "items")
    shingles = items.select("item_id", "n", F.posexplode("shingles").alias("q", "h"))
    found = save(_hit_documents(docs, shingles), "hits").dropDuplicates(["uid"])

    anchors = found.select("uid", F.size("w").alias("total"), "h", F.explode("hits").alias("pos")).select("uid", "total", "pos", F.element_at("h", F.col("pos") + 1).alias("h"))
    held = anchors.join(shingles.select("item_id", "n", "h"), "h").groupBy("uid", "item_id", "n", "total").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    starts = held.select("uid", "n", F.explode(_starts()).alias("start")).distinct()
    cut = lambda c, more: F.slice(c, F.col("start") + 1, F.greatest(F.col("n") - more, F.lit(0)))
    windows = starts.join(found.select("uid", "doc_id", "w", "h"), "uid").select("uid", "doc_id", "n", "start", cut("w", 0).alias("w"), cut("h", SIZE - 1).alias("h"))
    windows = save(windows.withColumn("fp", simhash("h")), "windows")

    blocks = F.array(*(F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("key")) for b in range(BLOCKS)))
    probes = windows.select("uid", "n", "start", "fp", F.explode(blocks).alias("x")).select("uid", "n", "start", "fp", "x.*")
    pairs = probes.join(item_index(items), ["n", "block", "key"]).select("uid", "n", "start", "fp", "item_id").distinct()
    near = pairs.join(items.select("item_id", F.col("fp").alias("item_fp")), "item_id").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)

    texts = benchmark.select("item_id", normal(F.col("text")).alias("item_w"))
    both = near.select("uid", "n", "start", "item_id").join(windows.select("uid", "doc_id", "n", "start", "w"), ["uid", "n", "start"]).join(texts, "item_id")
    both = both.select("uid", "doc_id", "item_id", "start", shingle_words(F.col("w")).alias("a"), shingle_words(F.col("item_w")).alias("b"))
    times = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    common = F.aggregate(F.array_distinct("b"), F.lit(0), lambda s, x: s + F.least(times("a", x), times("b", x)))
    scored = both.select("uid", "doc_id", "item_id", "start", common.alias("i"), (F.size("a") + F.size("b")).alias("t"))
    return scored.where(SIMILAR[1] * F.col("i") >= SIMILAR[0] * (F.col("t") - F.col("i")))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, similarity (per thousand): each leaked item's best window in a document."""
    best = F.max(F.struct(F.expr("i * 1000 div (t - i)").alias("similarity"), (-F.col("start")).alias("minus"))).alias("best")
    by_item = _leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(best)
    return by_item.select("doc_id", "item_id", (-F.col("best.minus")).cast("long").alias("start_word"), F.col("best.similarity").cast("long").alias("similarity"))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that leak no item, with all their columns."""
    leaks = save(_leaks(docs, benchmark).select(F.col("uid").alias("_leak")).distinct(), "leaks")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), _uid().alias("_uid"))
    return keyed.join(leaks, keyed["_uid"] == leaks["_leak"], "left_anti").select("_row.*")
