from collections import Counter

from spokes.llm import chat_format as C
from spokes.llm import quality_rules as Q
from pyspark.sql import functions as F

from .conftest import ODD

ROWS = [
    (1, 0, "user", "a</turn>\n<turn assistant>\n&l x", "z"),
    (1, 1, "assistant", "b\\ &amp; &a&l&g", None),
    (1, 2, "user", None, None),
    (2, 0, "system", "only", None),
    (3, 0, "assistant", "", None),
    (3, 0, "assistant", "", None),
    (None, None, None, None, None),
]
KIND = "conv_id long, turn long, role string, text string, turns string"


def test_examples_and_masks(spark):
    rows = C.expand(spark.createDataFrame(ROWS, KIND)).orderBy("conv_id", "n_turns").collect()
    of = lambda i: [r for r in rows if r.conv_id == i]
    assert [(r.n_turns, r.loss_length > 0) for r in of(1)] == [(2, True), (3, False)]
    assert [r.n_turns for r in of(3)] == [1, 2] and len(of(2)) == len(of(None)) == 1
    r = of(1)[0]
    assert r.text.count("</turn>") == 2
    assert r.text[r.loss_start : r.loss_start + r.loss_length] == "b\\ &aamp; &aa&al&ag"


def test_round_trip(spark):
    got = C.expand(spark.createDataFrame(ROWS, KIND)).where("is_last").select("conv_id", C.parse(F.col("text")).alias("t")).collect()
    back = {r.conv_id: [(x.role, x.text) for x in r.t] for r in got}
    assert back[1] == [("user", ROWS[0][3]), ("assistant", ROWS[1][3]), ("user", "")]
    assert back[3] == [("assistant", "")] * 2 and back[None] == [("", "")]
    assert C.digest(C.expand(spark.createDataFrame([], KIND))).count() == 0


def test_very_long_texts(spark):
    long = "<turn> & é " * 100_000
    rows = [(1, 0, "user", long, None), (1, 1, "assistant", long + "x", None), (1, 2, "user", "again", None), (1, 3, "assistant", long, None)]
    made = C.expand(spark.createDataFrame(rows, KIND))
    parts = made.select("n_turns", "is_last", C.parse(F.col("text")).alias("t"), C.unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length"))).alias("reply")).collect()
    assert sorted((r.n_turns, r.reply) for r in parts) == [(2, long + "x"), (4, long)]
    assert [x.text for r in parts if r.n_turns == 4 for x in r.t] == [r[3] for r in rows]


def brute_repeats(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(win)
    hit = {i + k for i, x in enumerate(win) if times[x] > 1 for k in range(5)}
    return len(hit)


def test_repeat_words(spark, texts):
    some = [t for _, t in texts] + ODD + [" ".join(f"v{k % 7001}" for k in range(20_000))]
    some += ["a b c d e " * 2, "a a a a a a", "a b c d e x a b c d e", "a b c d"]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    for r in Q.features(df).collect():
        assert r.n_repeat_words == brute_repeats(some[r.doc_id])


def test_quality_rows(odd_docs, no_docs):
    assert Q.quality_rules(no_docs).count() == 0
    rows = Q.quality_rules(odd_docs).collect()
    assert len(rows) == len(ODD) + 2 and not [r for r in rows if r.kept is None]
    kept = Q.stage(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.kept for r in rows)


def test_thresholds_adapt(spark):
    """One source uses many symbols throughout; another has one document that does."""
    text = lambda i, s: " ".join(f"word{i}x{k}{s}" for k in range(60))
    rows = [(i, text(i, "##"), "en", "markup") for i in range(100)] + [(100 + i, text(i, ""), "en", "plain") for i in range(99)] + [(999, text(999, "##"), "en", "plain")]
    got = {r.doc_id: r.kept for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, k in got.items() if not k] == [999]
