"""Quality classifier: an interpolated modified Kneser-Ney model over characters.

Texts are read as UTF-16 units, so any script has its own characters; an n-gram is
ORDER units in one 64-bit number, and zeros stand before a text.

* One pass counts the n-grams of all texts and of the trusted ones (``labels.quality``
  1). Each task adds up its own first, so a shard of the counts gets one row per
  n-gram and task. What is gathered grows with the characters in use.
* The model is estimated by joins of count tables keyed by n-gram and context: per
  order the discounted counts, the weight of the lower order, and the lower order's
  estimate. Lower orders count distinct left neighbours, as Kneser and Ney do.
* Surprisals of all n-grams of the corpus, whether the trusted text has them or not,
  come from joins with those tables, order by order.
* A document's perplexity adds up its n-grams' surprisals. Those of at most MOST of the
  most frequent n-grams (from a histogram of counts over the whole table) are
  broadcast, which bounds the broadcast; all others are joined by n-gram. Such an
  n-gram can't be a hot key, as MOST others are more frequent.
* A document is kept unless its mean surprisal, less MARGIN standard errors (short
  texts vary more), exceeds the QUANTILE of trusted documents of its language, from
  mergeable bins of a thousandth nat. A language of fewer than MIN_DOCS trusted
  documents takes the quantile of all.

Trusted ids are broadcast up to MOST_IDS of them; beyond that Spark decides.

Defined cases: null or empty text: perplexity null, not kept; null doc_id: scored,
never trusted; null language: a language of its own; no trusted text: a uniform model
and no threshold, so every text is kept; very long texts: whole; ties: a document at
its threshold is kept; repeated rows: each is scored; empty tables: no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokes.storage import drop_saved, release, save

ORDER, BITS = 4, 16
SIZE = 1 << BITS
MOST, SLOT_BITS = 1 << 20, 21
QUANTILE, MARGIN, MIN_DOCS, MOST_IDS = 0.995, 2.5, 50, 1_000_000
SLACK = 50  # thousandths of a nat
#: Units of text that a task looks at together, and distinct n-grams that it holds before it hands them on.
TOGETHER, HELD = 1 << 20, 1 << 21


def codes(text: str | None):
    """The n-gram that ends at each unit."""
    import numpy as np

    units = np.frombuffer((text or "").encode("utf-16-le", "replace"), "<u2").astype(np.uint64)
    out = units.copy()
    for k in range(1, ORDER):
        out[k:] |= units[: max(len(units) - k, 0)] << np.uint64(BITS * k)
    return out.view(np.int64)


def _sum_by_key(keys, *values):
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """code, n (in all texts), t (in texts marked ``trusted``)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        none = np.zeros(0, np.int64)
        held = (none, none, none)
        waiting: list = [[], []]
        room = 0

        def merged():
            parts = [held]
            for mark in (0, 1):
                some, n = np.unique(np.concatenate([none, *waiting[mark]]), return_counts=True)
                parts.append((some, n, n * mark))
                waiting[mark] = []
            return _sum_by_key(*(np.concatenate(x) for x in zip(*parts, strict=True)))

        def rows(x):
            for s in range(0, len(x[0]), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 65_536]) for c in x], names=["code", "n", "t"])

        for b in batches:
            for s in range(0, b.num_rows, 256):
                some = b.slice(s, 256)
                for text, mark in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    x = codes(text)
                    for k in range(0, len(x), TOGETHER):
                        waiting[bool(mark)].append(x[k : k + TOGETHER])
                        room += len(waiting[bool(mark)][-1])
                        if room >= TOGETHER:
                            held, room = merged(), 0
                            if len(held[0]) >= HELD:
                                yield from rows(held)
                                held = (none, none, none)
        yield from rows(merged())

    return docs.select("text", "trusted").mapInArrow(run, "code long, n long, t long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    n = counts.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    y = n.n1 / (n.n1 + 2 * n.n2) if n.n1 + n.n2 else 0.5
    of = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else k / 2
    return of(1, n.n1, n.n2), of(2, n.n2, n.n3), of(3, n.n3, n.n4)


def _context(code: str) -> Column:
    return F.shiftrightunsigned(F.col(code), BITS)


def _last(code: str, k: int) -> Column:
    """The last ``k`` units of an n-gram."""
    return F.col(code).bitwiseAND(F.lit((1 << BITS * k) - 1)) if k < ORDER else F.col(code)


def estimate(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per order from 1: (code, p) of what was seen, and (context, gamma), the weight of the order below. ``counts``: code, n."""
    adjusted = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        adjusted[k] = save(adjusted[k + 1].groupBy(_last("code", k).alias("code")).agg(F.count("*").alias("n")), "continuations")
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, ORDER + 1):
        d = _discounts(adjusted[k])
        rows = adjusted[k].select("code", "n", _context("code").alias("context"), _last("code", k - 1).alias("lower"))
        by = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        weights = save(rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(by) / F.sum("n")).alias("gamma")), "weights")
        joined = rows.join(weights, "context").select("code", "lower", "gamma", ((F.col("n") - by) / F.col("total")).alias("alpha"))
        if k == 1:
            below = joined.withColumn("q", F.lit(1 / SIZE))
        else:
            below = joined.join(out[-1][0].select(F.col("code").alias("lower"), F.col("p").alias("q")), "lower")
        out.append((save(below.select("code", (F.col("alpha") + F.col("gamma") * F.col("q")).alias("p")), "estimates"), weights.select("context", "gamma")))
    return out


def probabilities(model: list[tuple[DataFrame, DataFrame]], codes_: DataFrame) -> DataFrame:
    """code, p of the n-grams ``codes_`` (distinct), seen by the model or not."""
    need = {ORDER: codes_.select("code")}
    for k in range(ORDER - 1, 0, -1):
        need[k] = save(need[k + 1].select(_last("code", k).alias("code")).distinct(), "needed")
    p = None
    for k, (seen, weights) in enumerate(model, 1):
        rows = need[k].select("code", _context("code").alias("context"), _last("code", k - 1).alias("lower"))
        rows = rows.join(seen, "code", "left").join(weights, "context", "left")
        rows = rows.withColumn("q", F.lit(1 / SIZE)) if p is None else rows.join(p.select(F.col("code").alias("lower"), F.col("p").alias("q")), "lower")
        p = save(rows.select("code", F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("p")), "probabilities")
    return p


class Surprisals:
    """Looks n-grams up among the broadcast ones: by one slot of a hash first, by search where another n-gram has the slot."""

    def __init__(self, code, nats):
        import numpy as np

        order = np.argsort(code)
        self.code, self.nats = code[order], nats[order]
        self.slots, self.values = np.zeros(1 << SLOT_BITS, np.int64), np.full(1 << SLOT_BITS, np.nan)
        at = self.slot(code[::-1])  # they come with the most frequent first, which is to keep a slot
        self.slots[at], self.values[at] = code[::-1], nats[::-1]

    def slot(self, code):
        import numpy as np

        return (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def __call__(self, x):
        """Surprisal of each, not a number for those that aren't there."""
        import numpy as np

        at = self.slot(x)
        out = np.where(self.slots[at] == x, self.values[at], np.nan)
        rest = np.flatnonzero(np.isnan(out))
        if len(rest) and len(self.code):
            y = x[rest]
            k = np.minimum(np.searchsorted(self.code, y), len(self.code) - 1)
            out[rest] = np.where(self.code[k] == y, self.nats[k], np.nan)
        return out


_tables: dict[str, Surprisals] = {}


def _table(sent) -> Surprisals:
    """One for all tasks of a Python worker; another broadcast takes its place."""
    name, code, nats = sent.value
    if name not in _tables:
        _tables.clear()
        _tables[name] = Surprisals(code, nats)
    return _tables[name]


def _frequent(ngrams: DataFrame) -> Column:
    """The condition that at most MOST of the most frequent n-grams meet; a bin is an eighth of a power of two."""
    bin_ = F.floor(F.log2("n") * 8)
    least, room = 1 << 20, MOST
    for r in sorted(ngrams.groupBy(bin_.alias("bin")).agg(F.count("*").alias("size")).collect(), key=lambda r: -r.bin):  # at most 512 rows
        if r["size"] > room:
            break
        least, room = r.bin, room - r["size"]
    return bin_ >= least


def score(docs: DataFrame, surprisals: DataFrame) -> DataFrame:
    """doc_id, lang, trusted, n (units), nats (mean surprisal), error (its standard error) of each text. ``surprisals``: code, n, nats."""
    import numpy as np

    often = _frequent(surprisals)
    top = surprisals.where(often).select("code", "n", "nats").toArrow()  # at most MOST rows
    order = np.argsort(-top.column("n").to_numpy(), kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, top.column("code").to_numpy()[order], top.column("nats").to_numpy()[order]))

    def run(batches):
        import pyarrow as pa

        table = _table(sent)
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for b in batches:
            for s in range(0, b.num_rows, 256):
                some = b.slice(s, 256)
                out: tuple = ([], [], [], [], [])
                for text in some.column(3).to_pylist():
                    x = codes(text)
                    v = table(x)
                    miss = np.isnan(v)
                    rest, times = np.unique(x[miss], return_counts=True)
                    v = v[~miss]
                    for c, y in zip(out, (len(x), v.sum(), (v * v).sum(), rest, times), strict=True):
                        c.append(y)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:3], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "lang", "trusted", "n", "s1", "s2", "rest", "times"]
                )

    schema = "doc_id long, lang string, trusted boolean, n long, s1 double, s2 double, rest array<long>, times array<long>"
    here = save(docs.select("doc_id", "lang", "trusted", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "sums")
    pairs = here.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("code"), F.col("x.times").alias("times"))
    more = pairs.join(surprisals.where(~often).select("code", "nats"), "code")
    more = more.groupBy("row").agg(F.sum(F.expr("times * nats")).alias("m1"), F.sum(F.expr("times * nats * nats")).alias("m2"))
    full = here.drop("rest", "times").join(more, "row", "left").withColumn("s1", F.expr("s1 + coalesce(m1, 0)")).withColumn("s2", F.expr("s2 + coalesce(m2, 0)"))
    mean = F.when(F.col("n") > 0, F.col("s1") / F.col("n"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean) / F.col("n"))
    return full.select("doc_id", "lang", "trusted", "n", mean.alias("nats"), F.when(F.col("n") > 0, spread).alias("error"))


def _thresholds(trusted: DataFrame) -> tuple[DataFrame, int | None]:
    """(lang, high) and the quantile of all, in thousandths of a nat, from (lang, nats) of trusted documents."""
    bins = trusted.where("nats IS NOT NULL").groupBy("lang", F.floor(F.col("nats") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    bins = save(bins, "bins")
    every = sorted((r.bin, r.n) for r in bins.groupBy("bin").agg(F.sum("n").alias("n")).collect())  # a surprisal is under 50 nats, so at most 50,000 rows
    total, upto, high = sum(n for _, n in every), 0, None
    for at, n in every:
        upto += n
        if upto >= total * QUANTILE:
            high = at
            break
    over = Window.partitionBy("lang")
    run = bins.select("*", F.sum("n").over(over.orderBy("bin")).alias("upto"), F.sum("n").over(over).alias("total"))
    own = run.where(F.col("upto") >= F.col("total") * QUANTILE).groupBy("lang").agg(F.min("bin").alias("high"), F.max("total").alias("total"))
    return own.where(F.col("total") >= MIN_DOCS).select("lang", "high"), high


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_units (of UTF-16), perplexity (rounded to 6 places), kept, per row of ``docs``."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    few = ids.limit(MOST_IDS + 1).count() <= MOST_IDS
    mark = ids.withColumn("mark", F.lit(True))
    marked = docs.select("doc_id", "lang", "text").join(F.broadcast(mark) if few else mark, "doc_id", "left")
    marked = marked.select("doc_id", "lang", "text", F.coalesce("mark", F.lit(False)).alias("trusted"))
    ngrams = save(count_ngrams(marked), "ngrams")
    release(docs.sparkSession)
    p = probabilities(estimate(ngrams.where("t > 0").select("code", F.col("t").alias("n"))), ngrams)
    surprisals = save(ngrams.select("code", "n").join(p, "code").select("code", "n", (-F.log("p")).alias("nats")), "surprisals")
    drop_saved(ngrams)
    release(docs.sparkSession)
    scored = save(score(marked, surprisals), "scores")
    drop_saved(surprisals)
    cuts, every = _thresholds(scored.where("trusted"))
    joined = scored.join(cuts.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    low = (F.col("nats") - MARGIN * F.col("error")) * 1000
    limit = F.coalesce(F.col("high"), F.lit(every).cast("long")) + SLACK
    return joined.select(
        "doc_id",
        F.col("n").alias("n_units"),
        F.round(F.exp("nats"), 6).alias("perplexity"),
        (F.col("nats").isNotNull() & F.coalesce(low <= limit, F.lit(True))).alias("kept"),
    )
