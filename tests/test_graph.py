"""Graph operators against hand-made cases and plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F
from spokes.functions import jsonx
from spokes.functions import text as X
from spokes.operators import graph as G
from spokes.operators import infer as I
from spokes.operators import resolve as R
from spokes.operators import triples as T
from spokes.operators.components import connected_components
from spokes.schema import TRIPLE


def make(spark, rows):
    """(s, p, o) or (s, p, o, inferred) or with a chunk, in order."""
    full = [(r[0], r[1], r[2], r[4] if len(r) > 4 else 1, r[3] if len(r) > 3 else False, (0, 0, 1, i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, TRIPLE)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(
    "n, size, overlap, want",
    [
        (4, 4, 1, None),
        (0, 4, 1, None),
        (5, 4, 1, [(0, 4), (3, 5)]),
        (8, 4, 0, [(0, 4), (4, 8)]),
        (10, 4, 1, [(0, 4), (3, 7), (6, 10), (9, 10)]),
        (7, 4, 2, [(0, 4), (2, 6), (4, 7), (5, 7)]),
    ],
)
def test_chunks(spark, n, size, overlap, want):
    w = [f"w{i}" for i in range(n)]
    text = "  ".join(w) + "\n"
    got = X.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), size, overlap).orderBy("chunk").collect()
    assert [r.text for r in got] == ([text] if want is None else [" ".join(w[a:b]) for a, b in want])


def test_published_chunk_lengths(spark):
    text = " ".join(map(str, range(966)))
    got = X.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk").collect()
    assert [r.n_words for r in got] == [100] * 11 + [86, 20]
    with pytest.raises(ValueError):
        X.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 4, 3)


def test_text_columns(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y
    short = {"led to": "led to", "a  b": "a  b", "is located in the north": "is located", "part of the whole": "part of", "led to via steam engine": "led to via"}
    for p, want in short.items():
        assert one(X.limit_predicate, p) == want
    assert one(lambda c: X.limit_predicate(c, 1), "the big") == ""
    names = {"The University of Oxford": "university oxford", "AI-driven": "ai driven", "of the": "", "élan où": "élan où"}
    for n, want in names.items():
        assert one(X.normalize, n) == want
    assert one(X.stems, "capitalism is capitalist decays big") == ["capi", "deca"]


LADDER = {
    '```json\n[{"subject":"a","predicate":"p","object":"b"}]\n```': ("strict", 1),
    'Sure: [{"subject":"a","predicate":"p","object":"b"}] ok': ("slice", 1),
    '[{subject: "a", predicate: "p", object: "b",}]': ("repair", 1),
    '[{"subject":"a","predicate":"p","object":"b"},{"subject":"c"': ("salvage", 1),
    'See [1]: [{"subject":"a","predicate":"p","object":"b"}]': ("slice", 0),
    'x [{"subject":"a]","predicate":"p","object":"b"}] y': (None, 0),
    '{"subject":"a","predicate":"p","object":"b"}': ("strict", 0),
    "no list": (None, 0),
    '{"a":["b"]} done': ("slice", 0),
    '[{"subject":"a","predicate":null,"object":"b"},5,{"subject":"a","predicate":2,"object":"b"}]': ("strict", 1),
}


def test_json_ladder(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LADDER)], "id int, response string").withColumn("j", jsonx.ladder(F.col("response"))).select("id", "j.*")
    assert [r.stage for r in df.orderBy("id").collect()] == [w[0] for w in LADDER.values()]
    items = T.valid_items(jsonx.array_items(df.where("kind = 'array'")))
    found = {r.id: r.n for r in items.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert [found.get(i, 0) for i in range(len(LADDER))] == [w[1] for w in LADDER.values()]


def test_model_mapping_order(spark):
    rows = jsonx.mapping_rows(spark.createDataFrame([(json.dumps({"y": ["a"], "x": ["a", "y"]}),)], "value string"))
    got = R.apply_model_mapping(make(spark, [("a", "p", "b"), ("y", "p", "A")]), rows)
    assert values(got, "subject", "object") == [("x", "A"), ("x", "b")]


def brute_subsumption(names):
    order = sorted(names, key=lambda e: (len(e), e))
    out = {}
    for i, x in enumerate(order):
        for y in order[i + 1 :]:
            a, b = set(x.split()), set(y.split())
            s, t = ({w[:4] for w in z if len(w) > 4} for z in (a, b))
            if a and a <= b:
                out[y] = x
            elif b and b <= a:
                out[x] = y
            elif s & t and 2 * len(s & t) > max(len(s), len(t)):
                out[y] = x
    return out


def test_subsumption(spark):
    random.seed(3)
    parts = ["steam", "engine", "engines", "power", "capital", "capitalism", "capitalist", "mill", "old", "a", "b"]
    names = {" ".join(random.choices(parts, k=random.randint(1, 4))) for _ in range(150)} | {f"customer#{i:05d}" for i in range(60)} | {"x a b", "a      b"}
    df = spark.createDataFrame([(n,) for n in names], "standard string")
    assert {r.standard: r.target for r in R.subsumption(df).collect()} == brute_subsumption(names)


def test_representatives(spark):
    t = make(spark, [("The Steam Engine", "p", "steam engine"), ("steam engine", "p", "steam engine"), ("the war", "p", "war"), ("at war", "p", "an war")])
    got = dict(values(R.representatives(R.variant_groups(t)), "norm", "standard"))
    assert got == {"steam engine": "steam engine", "war": "war"}


def test_transitive(spark):
    t = make(spark, [("A", "p", "B"), ("B", "p", "C"), ("B", "q", "D"), ("A", "r", "D"), ("B", "q", "E")])
    assert values(I.transitive(t), "subject", "predicate", "object") == [("A", "indirectly p", "C"), ("A", "p via B", "E")]
    t = make(spark, [("x", "led to", "steam engine"), ("steam engine", "q", "y")])
    assert values(I.transitive(t), "predicate") == [("led to via",)]


def test_lexical(spark):
    t = make(spark, [("steam engine", "p", "x1"), ("steam power", "p", "x2"), ("cotton mill", "p", "x3"), ("mill owner", "p", "x4"), ("cotton gin", "p", "x5"), ("gin", "p", "x6"), ("ai", "p", "chair")])
    got = values(I.lexical(T.unique_entities(t), t), "subject", "predicate", "object")
    assert ("steam engine", "related to", "steam power") in got and ("cotton mill", "relates to", "mill owner") in got
    assert not [g for g in got if {g[0], g[2]} in ({"cotton gin", "gin"}, {"ai", "chair"})]
    assert ("steam engine", "is type of", "gin") in got  # containment is by characters
    free = make(spark, [("ai", "p", "q1"), ("chair", "p", "q2")])
    assert ("chair", "is type of", "ai") in values(I.lexical(T.unique_entities(free), free), "subject", "predicate", "object")


def test_dedupe(spark):
    t = make(spark, [("a", "p", "b", True), ("a", "p", "b", False, 1), ("a", "p", "b", False, 2), ("c", "p", "d", True), ("c", "p", "d", True)])
    rows = {r.subject: r for r in T.dedupe(t).collect()}
    assert (rows["a"].chunk, rows["a"].inferred, rows["a"].seq.pos) == (2, False, 0)
    assert (rows["c"].inferred, rows["c"].seq.pos) == (True, 3)


def test_fewer_than_two_rows_come_back(spark):
    t = make(spark, [("a", "p q r s t", "a")])
    assert values(I.infer(t), "subject", "predicate", "object") == [("a", "p q r s t", "a")]


def test_measures(spark):
    t = make(spark, [("a", "p", "b"), ("b", "p", "c"), ("d", "p", "e", True)])
    assert dict(values(G.degree(t), "node", "degree")) == {"a": 1, "b": 2, "c": 1, "d": 1, "e": 1}
    b = dict(values(G.betweenness(t), "node", "betweenness"))
    assert abs(b.pop("b") - 1 / 6) < 1e-12 and not any(b.values())
    s = G.stats(t, G.degree_communities(t)).first()
    assert (s.nodes, s.edges, s.inferred_edges, s.original_edges, s.communities) == (5, 3, 1, 2, 2)
    view = {r.node: r for r in G.node_view(t, connected_components(T.edges(t))).collect()}
    assert all(10 <= r["size"] <= 30 for r in view.values()) and view["b"]["title"] == "b - Connections: 2"


def test_components_are_an_equivalence(spark):
    random.seed(5)
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [(f"m{random.randint(0, 60)}", f"m{random.randint(0, 60)}") for _ in range(40)]
    lead = {}

    def find(x):
        lead.setdefault(x, x)
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        lead[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(pairs, "src string, dst string"))
    assert dict(values(got, "node", "component")) == {x: find(x) for x in lead}


def test_louvain_finds_two_cliques(spark):
    clique = lambda k: [(f"{k}{i}", "p", f"{k}{j}") for i in range(5) for j in range(i)]
    t = make(spark, clique("a") + clique("b") + [("a0", "p", "b0")])
    c = dict(values(G.louvain(t, connected_components(T.edges(t))), "node", "community"))
    assert {c[f"a{i}"] for i in range(5)} == {"a0"} and {c[f"b{i}"] for i in range(5)} == {"b0"}


def test_eigenvector(spark):
    t = make(spark, [("hub", "p", f"x{i}") for i in range(4)])
    e = dict(values(G.eigenvector(t), "node", "eigenvector"))
    assert abs(e["hub"] / e["x0"] - 2) < 1e-3
    assert {r.eigenvector for r in G.eigenvector(t, rounds=1).collect()} == {0.5}


def test_order_of_rows_and_partitions_is_without_effect(spark):
    rows = [(f"name {i % 7}", f"p{i % 3}", f"thing {i % 5}") for i in range(60)]
    t = make(spark, rows)
    want = values(I.infer(t), "subject", "predicate", "object", "inferred")
    for n in (1, 7):
        assert values(I.infer(t.orderBy(F.rand(n)).repartition(n)), "subject", "predicate", "object", "inferred") == want
