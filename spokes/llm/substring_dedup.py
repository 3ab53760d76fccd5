"""Substring dedup by level-wise doubling.

Wanted: words covered by a window of ``size`` words whose sequence also starts in
a document with a smaller id. A window can only repeat if the shorter windows in
it do, so lengths double: half windows (7 words for 13) that are found in one
document alone are dropped, and only windows around the surviving ones are
extended to the full length. What survives there is the answer; longer windows
cover no other words. If nothing survives a level, the next isn't run.

* Of the half windows only the minimizer of each full window is taken (the one
  whose hash is least): equal full windows have equal minimizers, so none is
  lost, and about a quarter of the half windows is shuffled.
* Counts are (min id, max id) per hash, combined before the shuffle, so a passage
  in a third of all documents is one row per task; the join back to the documents
  is an equi-join whose hot keys Spark splits.
* Full windows are compared by 96 bits, mixed in two ways from 64-bit hashes of their
  words: two words of one 64-bit hash count as equal.
* Documents with the same words as one of a smaller id are settled at once: all
  their words go if they have a window at all.

Every phase ends in a Parquet table in the shared folder.

Defined cases: null text: no words; fewer words than ``size``: nothing goes; null
doc_id: neither smaller nor larger than any, so nothing goes; rows of the same
doc_id don't remove each other's words but each is judged; very long texts: whole; ties:
the smallest doc_id that has a window keeps it; empty table: no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokes.llm._arrow import map_batches
from spokes.storage import drop_saved, release, save

SIZE = 13


def _minimizers(h, size: int):
    """(starts of the minimizers of all full windows, hashes of the half windows)."""
    import numpy as np

    from spokes.llm._hashes import windows

    half = (size + 1) // 2
    short = windows(h, half)
    if len(h) < size:
        return np.zeros(0, np.int64), short
    view = np.lib.stride_tricks.sliding_window_view(short, size - half + 1)
    return np.arange(len(view)) + view.argmin(axis=1), short


def _keys(h, size: int):
    import numpy as np

    from spokes.llm._hashes import windows

    return windows(h, size).view(np.int64), (windows(h, size, 1) >> np.uint64(33)).astype(np.int64)


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """row, doc_id, n_words, words_sha256, and the distinct minimizers."""

    def make():
        import numpy as np

        from spokes.llm._hashes import split_words, word_hashes, word_memo

        memo = word_memo()

        def each(c: dict) -> dict:
            out: dict = {"doc_id": c["doc_id"], "n_words": [], "sha": [], "halves": []}
            for text in c["text"]:
                w = split_words(text)
                at, short = _minimizers(word_hashes(memo, w), size)
                out["n_words"].append(len(w))
                out["sha"].append(hashlib.sha256(b" ".join(w)).digest())
                out["halves"].append(np.unique(short[np.unique(at)]).view(np.int64))
            return out

        return each

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_words long, sha binary, halves array<long>")


def _windows(texts: DataFrame, size: int) -> DataFrame:
    """doc_id, k1, k2 of the full windows whose minimizer is in ``hot``."""

    def make():
        import numpy as np

        from spokes.llm._hashes import split_words, word_hashes, word_memo

        memo = word_memo()

        def each(c: dict) -> dict:
            ids, k1, k2 = [], [], []
            for i, text, hot in zip(c["doc_id"], c["text"], c["hot"], strict=True):
                h = word_hashes(memo, split_words(text))
                at, short = _minimizers(h, size)
                some = np.isin(short[at].view(np.int64), hot)
                a, b = _keys(h, size)
                pairs = np.unique(np.stack([a[some], b[some]]), axis=1)
                ids.append(np.full(pairs.shape[1], i))
                k1.append(pairs[0])
                k2.append(pairs[1])
            return {n: np.concatenate(v) for n, v in (("doc_id", ids), ("k1", k1), ("k2", k2))}

        return each

    return map_batches(texts, make, "doc_id long, k1 long, k2 long")


def _cut(texts: DataFrame, size: int) -> DataFrame:
    """Removed spans (word offsets, end exclusive) and digest of texts whose repeated windows are in ``gone``."""

    def make():
        import numpy as np

        from spokes.llm._hashes import split_words, word_hashes, word_memo

        memo = word_memo()

        def each(c: dict) -> dict:
            out: dict = {"doc_id": c["doc_id"], "sha": [], "n_removed": [], "kept_sha256": [], "removed": []}
            for text, gone1, gone2 in zip(c["text"], c["gone1"], c["gone2"], strict=True):
                w = split_words(text)
                a, b = _keys(word_hashes(memo, w), size)
                order = np.lexsort((gone2, gone1))
                g1, g2 = gone1[order], gone2[order]
                at = np.minimum(np.searchsorted(g1, a), len(g1) - 1)
                hit = np.flatnonzero((g1[at] == a) & (g2[at] == b))
                if (g1[1:] == g1[:-1]).any():  # one first key with several second keys
                    pairs = set(zip(g1.tolist(), g2.tolist(), strict=True))
                    hit = np.array([i for i in np.flatnonzero(g1[at] == a) if (int(a[i]), int(b[i])) in pairs], np.int64)
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + size, -1)
                off = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8)))
                out["sha"].append(hashlib.sha256(b" ".join(w)).digest())
                out["n_removed"].append(int(off.sum()))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(x for x, o in zip(w, off.tolist(), strict=True) if not o)).hexdigest())
                out["removed"].append([{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2], strict=True)])
            return out

        return each

    return map_batches(texts, make, "doc_id long, sha binary, n_removed long, kept_sha256 string, removed array<struct<start int, end int>>")


def substring_dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (spans of word offsets) per row."""
    spark = docs.sparkSession
    scanned = save(_scan(docs, size), "halves")
    with_id = scanned.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= size))
    firsts = save(with_id.groupBy("sha").agg(F.min(F.struct("doc_id", "halves")).alias("f")).select("sha", "f.*"), "firsts")
    rows = save(scanned.drop("halves"), "rows")
    least = save(firsts.select("sha", F.col("doc_id").alias("lo")), "least")
    drop_saved(scanned)
    release(spark)
    halves = firsts.select("doc_id", F.explode("halves").alias("h"))
    shared = halves.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    hot = save(halves.join(shared, "h").groupBy("doc_id").agg(F.collect_set("h").alias("hot")), "hot")
    drop_saved(firsts)
    release(spark)

    texts = save(docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(hot, "doc_id"), "texts")
    drop_saved(hot)
    release(spark)
    full = _windows(texts, size)
    repeated = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("k1", "k2", "lo")
    gone = full.join(repeated, ["k1", "k2"]).where("doc_id > lo").groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("g"))
    gone = gone.select("doc_id", F.col("g.k1").alias("gone1"), F.col("g.k2").alias("gone2"))
    gone = save(gone, "gone")
    release(spark)
    cut = save(_cut(texts.select("doc_id", "text").join(gone, "doc_id"), size), "cut")
    drop_saved(texts)
    drop_saved(gone)
    release(spark)
    return _all_rows(rows, least, cut)


def _all_rows(rows: DataFrame, least: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows of every document: cut, a later copy of the same words, or whole.

    A doc_id of several rows gets each row's own result by its words' hash.
    """
    marked = rows.withColumn("all_sha", F.hex("sha")).join(least, "sha", "left")
    own = cut.dropDuplicates(["doc_id", "sha"]).withColumnsRenamed({c: f"cut_{c}" for c in ("n_removed", "kept_sha256", "removed")})
    both = marked.join(own, ["doc_id", "sha"], "left")
    copy = F.col("doc_id") > F.col("lo")
    span = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))
    empty = hashlib.sha256(b"").hexdigest()
    return both.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut_n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, empty).otherwise(F.coalesce("cut_kept_sha256", F.lower("all_sha"))).alias("kept_sha256"),
        F.when(copy, F.array(span(F.lit(0), F.col("n_words")))).otherwise(F.coalesce("cut_removed", F.expr("cast(array() as array<struct<start int, end int>>)"))).alias("removed"),
    )
