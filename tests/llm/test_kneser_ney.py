"""The quality classifier against a plain Kneser-Ney model."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from spokes.llm import kneser_ney as K

SF = "/root/testdata/sf0.001"
TEXTS = ["abab ab", "the cat sat on the mat", "日本語の日本", "the mat and the cat", "", None, "zebra 🙂", "a" * 300]
TRUSTED = [0, 1, 2, 3, 4]


class Plain:
    """Interpolated modified Kneser-Ney over UTF-16 units, by dictionaries."""

    def __init__(self, texts):
        grams = Counter(g for t in texts for g in self.grams(t))
        self.counts = {K.ORDER: grams}
        for k in range(K.ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.total, self.left = {}, {}, {}
        for k, c in self.counts.items():
            n = Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
            d = [min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.0), j) if n[j] else j / 2 for j in (1, 2, 3)]
            self.discount[k] = d
            self.total[k], self.left[k] = Counter(), defaultdict(float)
            for g, x in c.items():
                self.total[k][g[:-1]] += x
                self.left[k][g[:-1]] += d[min(x, 3) - 1]

    @staticmethod
    def grams(text):
        u = (0,) * (K.ORDER - 1) + tuple(np.frombuffer((text or "").encode("utf-16-le"), "<u2").tolist())
        return [u[i : i + K.ORDER] for i in range(len(u) - K.ORDER + 1)]

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / K.SIZE
        total, x = self.total[k][g[:-1]], self.counts[k][g]
        if not total:
            return self.p(g[1:])
        own = (x - self.discount[k][min(x, 3) - 1]) / total if x else 0.0
        return own + self.left[k][g[:-1]] / total * self.p(g[1:])

    def perplexity(self, text):
        g = self.grams(text)
        return math.exp(-sum(math.log(self.p(x)) for x in g) / len(g)) if g else None


@pytest.mark.parametrize("most", [K.MOST, 12, 0])
def test_perplexity_equals_the_plain_model(spark, monkeypatch, most):
    """With surprisals that are broadcast, that are joined, and both."""
    monkeypatch.setattr(K, "MOST", most)
    docs = spark.createDataFrame([(i, "en", t, 1) for i, t in enumerate(TEXTS)] + [(None, None, "the cat", 1)], "doc_id long, lang string, text string, code int")
    labels = spark.createDataFrame([(i, 1) for i in TRUSTED] + [(7, 0), (None, 1)], "doc_id long, quality int")
    plain = Plain([TEXTS[i] for i in TRUSTED])
    rows = K.classify(docs, labels).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = "the cat" if r.doc_id is None else TEXTS[r.doc_id]
        want = plain.perplexity(text)
        assert (r.perplexity is None and not r.kept) if want is None else abs(r.perplexity - want) < 1e-6 * max(1, want), (text, r.perplexity, want)


def test_probabilities_sum_to_one(spark):
    plain = Plain(["abab ab", "the cat"])
    seen = sorted({u for g in plain.counts[K.ORDER] for u in g if u})
    for context in ((0, 0, ord("a")), (ord("x"), ord("t"), ord("h")), (ord("b"), ord("a"), ord("b"))):
        known = sum(plain.p((*context, u)) for u in seen)
        assert abs(known + (K.SIZE - len(seen)) * plain.p((*context, 0xFFFF)) - 1) < 1e-9
    docs = spark.createDataFrame([("abab ab", True), ("the cat", True), (None, True), ("xx", False)], "text string, trusted boolean")
    counts = {r.code: (r.n, r.t) for r in K.count_ngrams(docs).collect()}
    as_code = lambda g: int(np.array([sum(u << 16 * k for k, u in enumerate(reversed(g)))], np.uint64).view(np.int64)[0])
    want = {as_code(g): (n, n) for g, n in plain.counts[K.ORDER].items()} | {as_code((0, 0, 0, ord("x"))): (1, 0), as_code((0, 0, ord("x"), ord("x"))): (1, 0)}
    assert counts == want


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", F.lit(True).alias("trusted"))
    want = {r.code: r.n for r in K.count_ngrams(docs).collect()}
    monkeypatch.setattr(K, "TOGETHER", 1000)
    monkeypatch.setattr(K, "HELD", 3000)
    assert {r.code: r.n for r in K.count_ngrams(docs).collect()} == want


def test_it_separates_labels(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = K.classify(docs, labels).join(labels, "doc_id").collect()
    share = lambda q: np.mean([r.kept for r in rows if r.quality == q])
    assert share(1) > 0.97 and share(0) < 0.5
    assert K.classify(odd_docs, labels.limit(0)).where("kept").count() == odd_docs.where("text <> ''").count()
    assert K.classify(no_docs, labels).count() == 0
