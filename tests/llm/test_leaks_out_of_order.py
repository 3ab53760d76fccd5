"""Benchmark items whose parts stand in another order, against all windows."""

from collections import Counter

from spokes.llm import decontaminate


def _best(doc, item):
    """(start, similarity per thousand) over every window of the item's length."""
    shingles = lambda x: Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
    b, best = shingles(item), None
    for s in range(max(1, len(doc) - len(item) + 1)):
        a = shingles(doc[s : s + len(item)])
        i = sum((a & b).values())
        t = a.total() + b.total()
        if 5 * i >= 4 * (t - i) and (best is None or i * 1000 // (t - i) > best[1]):
            best = (s, i * 1000 // (t - i))
    return best


def test_items_with_moved_parts_are_found(spark):
    item = [f"w{k}" for k in range(59)]
    around = lambda x: [f"a{k}" for k in range(50)] + x + [f"z{k}" for k in range(40)]
    docs = [around(item[29:] + item[:29]), around(item[51:] + item[:51]), around(item[8:] + item[:8]), item[29:] + item[:29], around(item[:29]), around(item[20:40] + item[40:] + item[:20])]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: (r.start_word, r.similarity) for r in decontaminate.find_leaks(rows, bench).collect()}
    want = {i: _best(d, item) for i, d in enumerate(docs)}
    assert want[0] == (50, 864) and want[4] is None
    assert got == {i: w for i, w in want.items() if w}


def test_stage_judges_rows_of_one_id_by_their_own_text(spark):
    item = " ".join(f"w{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item, "x"), (1, "clean", "x"), (1, "clean", "y"), (None, "a " + item, "x"), (None, None, "x"), (2, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    got = [(r.doc_id, r.text, r.uid) for r in decontaminate.stage(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if not r[1] or "w1" not in r[1]], key=str)
