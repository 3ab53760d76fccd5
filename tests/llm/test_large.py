"""Operators over pairs and the pipeline, against brute force."""

import hashlib
import itertools

import numpy as np
import pytest
from spokes.llm import byte_bpe, decontaminate, jaccard_join, q04, substring_dedup

from .conftest import ODD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load(q04.ranks()), special_tokens={})


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        out.setdefault(frozenset(s), []).append(i)
    return out


def classes_of(rows):
    """doc_id to (class, links), comparing all pairs."""
    sets = {s: ids for s, ids in sets_of(rows).items() if s}
    lead, links = {s: s for s in sets}, dict.fromkeys(sets, 0)

    def find(s):
        while lead[s] is not s:
            s = lead[s]
        return s

    for a, b in itertools.combinations(sets, 2):
        if 5 * len(a & b) >= 4 * len(a | b):
            links[a] += 1
            links[b] += 1
            lead[find(a)] = find(b)
    least = {}
    for s, ids in sets.items():
        least[find(s)] = min([least.get(find(s), min(ids)), *ids])
    return {i: (least[find(s)], links[s]) for s, ids in sets.items() for i in ids}


def near_copies(n, words=60):
    """n texts that differ from one base in one or two words each, and n others that share half of it."""
    base = [f"w{k}" for k in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        w[i % words] = f"x{i}"
        if i % 3 == 0:
            w[(i * 7) % words] = f"y{i}"
        out += [" ".join(w), " ".join(base[: words // 2] + [f"z{i}_{k}" for k in range(words // 2)])]
    return out


def test_jaccard_classes_and_links(spark, odd_docs, no_docs, texts):
    rows = texts + [(1000 + i, t) for i, t in enumerate(near_copies(80))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes_of(rows)
    assert len(got) == len(rows) and {i: got[i] for i in want} == want
    odd = jaccard_join.jaccard_join(odd_docs).collect()
    assert len(odd) == len(ODD) + 2 and all(r.class_id == r.doc_id and not r.n_links for r in odd)
    assert jaccard_join.jaccard_join(no_docs).count() == 0
    kept = jaccard_join.stage(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if want.get(i, (i,))[0] == i}


def removed(rows, size=13):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, i), i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(size)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def test_substring_dedup(spark, odd_docs, no_docs, texts):
    rows = texts + [(1000 + i, t) for i, t in enumerate(near_copies(30))] + [(2000, "a " * 40), (2001, "a " * 12), (2002, "b " + "a " * 13)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(rows)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    odd = substring_dedup.substring_dedup(odd_docs).collect()
    assert len(odd) == len(ODD) + 2 and not any(r.n_removed for r in odd)
    assert substring_dedup.substring_dedup(no_docs).count() == 0


def test_decontamination(spark, odd_docs, no_docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    long = max(items, key=lambda i: len(items[i].split()))
    w = items[long].split()
    edited = list(w)
    edited[len(w) // 2] = "changed"
    rows = [(1, "before it " + items[long].upper() + " after it"), (2, " ".join(["x y z"] + edited)), (3, " ".join(w[: len(w) // 2])), (4, " ".join(w[1:])), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got[1, long] == (2, 1000) and (4, long) in got and (3, long) not in got
    shingles = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
    both = len(shingles(w) & shingles(edited)) / len(shingles(w) | shingles(edited))
    assert ((2, long) in got) == (both >= 0.8)
    monkeypatch.setattr(decontaminate, "MOST_LITERALS", 10)  # the joined form finds the same
    assert {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontaminate.find_leaks(docs, bench).collect()} == got
    monkeypatch.undo()
    assert decontaminate.find_leaks(odd_docs, bench).count() == decontaminate.find_leaks(no_docs, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.stage(odd_docs, bench).count() == odd_docs.count()


def coded(tokenizer, rows):
    def of(i, t):
        ids = tokenizer.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    return sorted((of(i, t) for i, t in rows), key=str)


@pytest.mark.parametrize("most", [byte_bpe.MOST_WORDS, 40, 0])
def test_bpe(spark, odd_docs, no_docs, tokenizer, texts, monkeypatch, most):
    """Words that are broadcast, that are joined, and both, over nulls, long texts, repeated rows and clashing columns."""
    monkeypatch.setattr(byte_bpe, "MOST_WORDS", most)
    more = ["  two  spaces\n\n\nlines \t", "é  x", "a" * 200_000, "ab" * 1500 + "c" * 777, "'s's 'S don't I'LL x 's", "١٢٣ ⅷ ² a\x1c b \x85 c", "\x00 z"]
    rows = [(100 + i, t) for i, t in enumerate(more)] + [(1000 + i, t) for i, t in texts[:60]]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = byte_bpe.encode_with_digest(docs, q04.ranks(), keep_ids=True).collect()
    every = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()] + rows
    assert sorted((r[:4] for r in map(tuple, got)), key=str) == coded(tokenizer, every)
    assert all(hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in got)
    assert byte_bpe.encode(no_docs, q04.ranks()).count() == 0


def test_bpe_folds_tokens_and_decodes(spark, tokenizer):
    ranks = byte_bpe.load(q04.ranks())
    assert byte_bpe.is_ordered(ranks)
    assert not byte_bpe.is_ordered({b"a": 0, b"b": 1, b"c": 2, b"ab": 9, b"abc": 5})
    some = [t.decode() for t in ranks if len(t) > 1 and t.isascii()][::40]
    rows = spark.createDataFrame([(w, k) for w in some for k in (1, 2)], "word string, n long")
    got = byte_bpe.fold_words(rows, q04.ranks()).collect()
    assert sorted(r.word for r in got) == sorted(some)
    assert all(r.n == 3 and bytes(r.code) == ranks[r.word.encode()].to_bytes(4, "little") for r in got)
    assert byte_bpe.decode(tokenizer.encode_ordinary("naïve 日本"), q04.ranks()).decode() == "naïve 日本"


def test_pipeline(spark, tokenizer):
    import corpus_pipeline as C
    import public_tokenizers
    from spokes.llm import secret_scan

    words = secret_scan.ranks(public_tokenizers.path("word_bpe_49k.json"))

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    one = C.keep_good(spark, docs, SF)
    assert one.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in one.collect()]
    cls = classes_of(rows)
    left = {i: t for i, t in rows if cls.get(i, (i,))[0] == i}
    leaked = {i for i, t in left.items() if any(" ".join(b.split()) in " ".join(t.split()) for b in bench)}
    want = {i: tokenizer.encode_ordinary(secret_scan.redact(t, words)) for i, t in left.items() if i not in leaked}
    got = {r.doc_id: list(r.ids) for r in C.run(spark, SF).collect()}
    assert got == want


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, tokenizer, tmp_path):
    """Nulls, rows of one id, repeated rows, copies, extra columns with clashing names, and an empty table."""
    import corpus_pipeline as C

    text = lambda i: " ".join(f"word{i}x{k}" for k in range(60))
    good = [(100, text(1)), (100, text(2)), (101, text(1)), (102, text(3)), (102, text(3)), (None, text(4)), (103, "x" * 30 + " " + text(5))]
    rows = spark.createDataFrame([(i, t, "en", None, len(t), "a", "b") for i, t in good], odd_docs.schema)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, docs in (("odd", odd_docs.union(rows)), ("none", no_docs)):
        docs.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"file://{tmp_path}/{name}/benchmark.parquet")
    got = C.run(spark, f"file://{tmp_path}/odd").collect()
    want = [(100, text(1)), (100, text(2)), (102, text(3)), (None, text(4)), (103, good[-1][1])]
    ids = sorted(((r.doc_id, list(r.ids)) for r in got if r.doc_id is None or r.doc_id >= 100), key=str)
    assert ids == sorted(((i, tokenizer.encode_ordinary(t)) for i, t in want), key=str)
    assert C.run(spark, f"file://{tmp_path}/none").count() == 0


def test_bpe_moves_texts_as_frames(spark, tokenizer, monkeypatch):
    """What is shuffled with a text is a fraction of it, and texts without joined words, empty and null ones come back whole."""
    monkeypatch.setattr(byte_bpe, "MOST_WORDS", 20)
    rows = [(i, f"some words{i} that come again and again, " * 40) for i in range(30)] + [(30, ""), (31, None), (32, "again"), (None, "null id")]
    made, real = [], byte_bpe.save
    monkeypatch.setattr(byte_bpe, "save", lambda df, name, path=None: made.append(name) or real(df, name, path))
    out = byte_bpe.encode_with_digest(spark.createDataFrame(rows, "doc_id long, text string"), q04.ranks())
    assert sorted(map(tuple, out.collect()), key=str) == coded(tokenizer, rows)
    assert made[-1] == "lists"
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "frame" in plan.split("Join")[1]
