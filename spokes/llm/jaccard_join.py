"""N-gram Jaccard join by chosen paths.

Documents are sets of 5-word shingles; two texts are linked if the Jaccard
similarity of their sets is SIMILAR or more. Documents of equal sets are one
class, represented by its least doc_id, before anything is compared.

Candidates: each set is embedded as T minhashes, a fixed number of sampled tokens.
A run starts at one sampled position: a bucket is the sets that hold the same sampled
token there. Buckets of at most SMALL are compared pair by pair. A larger bucket is
split again on the next sampled token of its path. In a large bucket, the sets that
look like its pivot (the set of the least key, so mostly the same one in all buckets
of a group) are put into the pivot's group and carry its label; a bucket whose sets
carry one label is done, as all of its pairs are candidates. A bucket of which a share of
MOSTLY or more looks like the pivot is put into its group whole, and is done: that adds
candidates and loses none, where a few sets that look otherwise would make all others
go on by every path. So a large group of near copies is split once or twice and not
compared for ever. Sets leave the recursion if they are
so near to the pivot that anything SIMILAR to them was put there too (Jaccard
distance is a metric; SETTLED exceeds 0.8 by about two standard errors of an estimate
from T minhashes). What is still in a large bucket after DEEPEST splits is put into
its pivot's group as well. A set leaves by two paths at the depths FORKS, each with a
position drawn anew by the path, so that what splits lose is made up for.

Runs are repeated until the expected recall at SIMILAR reaches RECALL in the worst
case, where all buckets stay large to full depth (:func:`runs_needed`; a test measures
it run by run). Where buckets are small a pair needs one shared token of any run.

Verification is exact: documents of one candidate component meet in cells of at
most two blocks of about BLOCK sets or BLOCK_CHARS characters, all pairs of a cell are
compared by their shingles, each text's links are counted, and of the links a spanning
forest is kept. A text is read once per block of its component, so a component of g
texts moves g * g / BLOCK rows; no row is made per pair, no group is capped, and no
component is held by one task.

Defined cases: null, empty or blank text: no set, its own class, no links; fewer
than five words: one shingle of all words; null doc_id: no links, class null;
rows of equal doc_id and text: the same class; empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokes.llm._arrow import map_batches
from spokes.operators.components import connected_components
from spokes.storage import drop_saved, release, save

SIZE, SIMILAR = 5, 0.8
T, SMALL, DEEPEST, BLOCK, BLOCK_CHARS = 64, 48, 8, 256, 2 << 20
RECALL = 0.99999
#: Of T minhashes: so many equal ones put two sets into one candidate group, or end a set's recursion.
ALIKE, SETTLED = int(0.5 * T), math.ceil(0.9 * T)
#: Share of sets like the pivot from which a bucket is one candidate group.
MOSTLY = 0.75
#: Depths at which a path of a large bucket forks.
FORKS = (1, 3, 5)


def runs_needed(recall: float, similar: float = SIMILAR) -> int:
    """Runs after which a pair of that similarity has met with probability ``recall``, if all its buckets stay large.

    Two sets go the same way at a split with probability ``similar``.
    """
    meet = 1.0
    for depth in range(DEEPEST - 2, -1, -1):
        meet = 1 - (1 - similar * meet) ** (2 if depth in FORKS else 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - similar * meet))


def shingles(memo, words: list[bytes], size: int = SIZE):
    """Sorted distinct hashes of the windows of ``size`` words; of all words if they are fewer."""
    import numpy as np

    from spokes.llm._hashes import windows, word_hashes

    h = word_hashes(memo, words)
    return np.unique(windows(h, min(size, len(h)))) if len(h) else np.zeros(0, np.uint64)


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (md5; null without a text), n_chars, sig (hash of the set; null without words), mh (T minhashes)."""

    def make():
        import hashlib

        import numpy as np
        import xxhash

        from spokes.llm._hashes import mix, split_words, word_memo

        memo = word_memo()
        by = mix(np.arange(1, T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

        def each(c: dict) -> dict:
            out: dict = {"doc_id": c["doc_id"], "text_id": [], "n_chars": [], "sig": [], "mh": []}
            for text in c["text"]:
                out["text_id"].append(None if text is None else hashlib.md5(text.encode()).digest())
                out["n_chars"].append(len(text or ""))
                s = shingles(memo, split_words(text))
                if not len(s):
                    out["sig"].append(None)
                    out["mh"].append(None)
                    continue
                least = np.full(T, 0xFFFFFFFF, np.uint64)
                for k in range(0, len(s), 2048):
                    np.minimum(least, ((s[k : k + 2048, None] * by) >> np.uint64(32)).min(axis=0), out=least)
                out["sig"].append(xxhash.xxh3_128_digest(s.tobytes()))
                out["mh"].append(least.astype(np.uint32).view(np.int32))
            return out

        return each

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, text_id binary, n_chars long, sig binary, mh array<int>")


def _equal(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def spanning_forest(linked) -> list[tuple[int, int]]:
    """(i, the one it was reached from) of a symmetric boolean matrix; a root is with itself, rows without links are left out."""
    import numpy as np

    out, left = [], linked.any(axis=1)
    for root in np.flatnonzero(left).tolist():
        if not left[root]:
            continue
        out.append((root, root))
        left[root], todo = False, [root]
        while todo:
            i = todo.pop()
            reached = np.flatnonzero(linked[i] & left).tolist()
            left[reached] = False
            out += [(j, i) for j in reached]
            todo += reached
    return out


def _pairs_of_small(buckets: DataFrame) -> DataFrame:
    """Spanning edges of the pairs that look alike in each small bucket (``sigs``, ``mhs``)."""

    def make():
        import numpy as np

        def each(c: dict) -> dict:
            src, dst = [], []
            for sigs, mhs in zip(c["sigs"], c["mhs"], strict=True):
                m = np.array(mhs, np.int32)
                near = (m[:, None, :] == m[None, :, :]).sum(axis=2) >= ALIKE
                for i, j in spanning_forest(near):
                    if i != j:
                        src.append(sigs[i])
                        dst.append(sigs[j])
            return {"src": src, "dst": dst}

        return each

    return map_batches(buckets.select("sigs", "mhs"), make, "src binary, dst binary")


def candidates(sets: DataFrame, runs: int | None = None) -> DataFrame:
    """Edges (src, dst) of sig between sets (``sig``, ``mh``) that may be similar.

    Rows of the recursion hold a 64-bit key for the set; the minhashes join them
    only in buckets of two sets or more.
    """
    spark = sets.sparkSession
    keyed = sets.select(F.xxhash64("sig").alias("key"), "sig", "mh")
    runs = runs or runs_needed(RECALL)
    roots = F.array(*(F.struct(F.lit(r).alias("root"), F.xxhash64(F.lit(r), F.element_at("mh", r % T + 1)).alias("path")) for r in range(runs)))
    rows = keyed.select("key", F.lit(None).cast("long").alias("label"), F.explode(roots).alias("b")).select("key", "label", "b.root", "b.path")
    found, before = [], ()
    for depth in range(DEEPEST):
        stats = rows.groupBy("root", "path").agg(
            F.count("*").alias("n"), F.expr("bit_xor(xxhash64(key))").alias("members"), F.min("key").alias("pivot"), F.count("label").alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")
        )
        sizes = save(stats.where("n > 1 AND NOT (k = n AND lo = hi)").select("root", "path", "n", "members", "pivot"), "buckets")
        # Buckets of the same members are compared once.
        small = sizes.where(F.col("n") <= SMALL).groupBy("n", "members").agg(F.min("root").alias("root"), F.min_by("path", "root").alias("path")).select("root", "path")
        groups = rows.join(small, ["root", "path"]).join(keyed, "key").groupBy("root", "path").agg(F.collect_list("sig").alias("sigs"), F.collect_list("mh").alias("mhs"))
        found.append(save(_pairs_of_small(groups).distinct(), "pairs"))
        large = sizes.where(F.col("n") > SMALL).select("root", "path", "pivot")
        if large.isEmpty():
            break
        pivots = keyed.select(F.col("key").alias("pivot"), F.col("sig").alias("pivot_sig"), F.col("mh").alias("pivot_mh"))
        inside = rows.join(large.join(pivots, "pivot"), ["root", "path"]).join(keyed, "key")
        told = inside.select("key", "label", "root", "path", "sig", "mh", "pivot", "pivot_sig", _equal(F.col("mh"), F.col("pivot_mh")).alias("equal"))
        told = saved = save(told, "told")
        # Few rows, one per bucket; counted per task before the shuffle.
        whole = told.groupBy("root", "path").agg(F.avg((F.col("equal") >= ALIKE).cast("int")).alias("share")).where(F.col("share") >= MOSTLY)
        whole = save(whole.select("root", "path", F.lit(True).alias("whole")), "whole")
        told = told.join(whole, ["root", "path"], "left")
        near = (F.col("equal") >= ALIKE) | F.col("whole").isNotNull() | F.lit(depth == DEEPEST - 1)
        found.append(save(told.where((F.col("sig") != F.col("pivot_sig")) & near).select(F.col("sig").alias("src"), F.col("pivot_sig").alias("dst")).distinct(), "pairs"))
        for done in before:
            drop_saved(done)
        drop_saved(sizes)
        release(spark)
        forks = [F.xxhash64("path", F.lit(depth), F.lit(f)) for f in range(2 if depth in FORKS else 1)]
        fork = F.explode(F.array(*forks)) if len(forks) > 1 else forks[0]
        at = F.pmod(F.col("fork"), F.lit(T)).cast("int") + 1
        label = F.when(F.col("equal") >= ALIKE, F.col("pivot")).otherwise(F.col("label")).alias("label")
        left = told.where(F.col("whole").isNull() & (F.col("equal") < SETTLED)).select("key", label, "root", "mh", fork.alias("fork"))
        rows, before = left.select("key", "label", "root", F.xxhash64("fork", F.element_at("mh", at)).alias("path")), (saved, whole)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return save(out.distinct(), "pairs")


def _verify(cells: DataFrame) -> DataFrame:
    """Per set and cell: its links there and its neighbour in a spanning forest of them. Cells are (component, a, b), blocks a <= b.

    Rows come sorted by cell, so a task holds one cell at a time.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        from spokes.llm._hashes import split_words, word_memo

        memo = word_memo()
        held: list[dict] = []
        names, kinds = ["sig", "links", "near"], (pa.binary(), pa.int64(), pa.binary())

        def solve():
            rows = {}  # once each, and only the text that has this set where a doc_id has several
            for r in held:
                s = shingles(memo, split_words(r["text"]))
                if xxhash.xxh3_128_digest(s.tobytes()) == r["sig"]:
                    rows[r["sig"]] = (r, s)
            if not rows:
                return pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)
            block, sets = np.array([r["block"] for r, _ in rows.values()]), [s for _, s in rows.values()]
            size = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), size)
            _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
            shared = count[inverse] > 1  # a shingle of one set adds to no pair
            owner, inverse = owner[shared], np.unique(inverse[shared], return_inverse=True)[1]
            both = np.zeros((len(sets), len(sets)), np.float32)
            order = np.argsort(inverse, kind="stable")
            owner, inverse = owner[order], inverse[order]
            most = int(inverse[-1]) + 1 if len(inverse) else 0
            wide = max(256, (4 << 20) // len(sets))  # so that no matrix takes more than 16 MB or so
            for s in range(0, most, wide):
                lo, hi = np.searchsorted(inverse, (s, s + wide))
                has = np.zeros((len(sets), min(wide, most - s)), np.float32)
                has[owner[lo:hi], inverse[lo:hi] - s] = 1
                both += has @ has.T
            linked = both * 10 >= 8 * (size[:, None] + size[None, :] - both)  # both / union >= 0.8, in whole numbers
            np.fill_diagonal(linked, False)
            if held[0]["a"] != held[0]["b"]:
                linked &= block[:, None] != block[None, :]
            sigs, forest, links = list(rows), spanning_forest(linked), linked.sum(axis=1)
            cols = [sigs[i] for i, _ in forest], [links[i] for i, _ in forest], [sigs[j] for _, j in forest]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            for r in b.to_pylist():
                if held and any(held[0][k] != r[k] for k in ("component", "a", "b")):
                    yield solve()
                    held = []
                held.append(r)
        if held:
            yield solve()

    return cells.mapInArrow(run, "sig binary, links long, near binary")


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, class_id, n_links and class_key (its least sig, null without words) per row."""
    spark = docs.sparkSession
    scanned = save(_scan(docs), "minhashes")
    known = scanned.where("sig IS NOT NULL AND doc_id IS NOT NULL")
    sets = save(known.groupBy("sig").agg(F.min(F.struct("doc_id", "mh", "n_chars")).alias("f")).select("sig", "f.*"), "sets")
    edges = candidates(sets.select("sig", "mh"))
    groups = save(connected_components(edges).select(F.col("node").alias("sig"), "component"), "groups")
    drop_saved(edges)
    release(spark)

    found = groups.join(sets.select("sig", "doc_id", "n_chars"), "sig")
    sized = groups.join(sets.select("sig", "n_chars"), "sig").groupBy("component").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    # A block is a hash class of sets, so that blocks need no numbering; cells are all pairs of blocks.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    members = found.join(sized, "component").select("component", "sig", "doc_id", blocks.alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    texts = members.join(docs.select("doc_id", "text"), "doc_id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = texts.select("component", "sig", "text", "block", other).select(
        "component", "sig", "text", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "component", "a", "b").sortWithinPartitions("component", "a", "b", "sig")
    checked = save(_verify(dealt), "links")
    release(spark)

    links = checked.groupBy("sig").agg(F.sum("links").alias("n_links"))
    classes = connected_components(checked.select(F.col("sig").alias("src"), F.col("near").alias("dst")))
    first = classes.join(sets, classes.node == sets.sig).groupBy("component").agg(F.min("doc_id").alias("class_id"))
    by_sig = save(classes.join(first, "component").join(links, classes.node == links.sig).select("sig", "component", "class_id", "n_links"), "classes")
    release(spark)
    of = sets.select("sig", F.col("doc_id").alias("own")).join(by_sig, "sig", "left")
    return (
        scanned.select("doc_id", "text_id", "sig")
        .join(of, "sig", "left")
        .select(
            "doc_id",
            "text_id",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "own", "doc_id")).alias("class_id"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            F.coalesce("component", "sig").alias("class_key"),
        )
    )


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of its linked texts), n_links (other texts it is similar to), per row."""
    return _classes(docs).select("doc_id", "class_id", "n_links")


def stage(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: of those of the least doc_id, the one of the least text hash.

    A doc_id may have rows of several texts; each is judged by its own text. Rows
    without words or without a doc_id all stay; of rows that are equal in doc_id and
    text, one.
    """
    rows = save(_classes(docs).where("class_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text_id", "class_key"), "rows")
    best = rows.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_id")).alias("b")).select("class_key", F.col("b.doc_id").alias("d"), F.col("b.text_id").alias("t"))
    gone = rows.join(best, "class_key").where("doc_id <> d OR text_id <> t")
    gone = save(gone.select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t")).distinct(), "near_copies")
    twice = rows.groupBy(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t")).agg(F.count("*").alias("n")).where("n > 1").select("_d", "_t")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_d"), F.unhex(F.md5("text")).alias("_t"))
    left = keyed.join(gone, ["_d", "_t"], "left_anti")
    twice = save(twice, "repeated")
    if not twice.isEmpty():
        left = left.join(twice, ["_d", "_t"], "left_anti").union(left.join(twice, ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"]))
    return left.select("_row.*")
