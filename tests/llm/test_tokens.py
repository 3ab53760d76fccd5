import hashlib
import zlib

import numpy as np
import public_tokenizers as P
from spokes.llm import q_tokens, token_count, token_store

from .conftest import ODD


def test_counts_equal_the_unigram_tokenizer(texts):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    # Bytes don't match as text: their strings get the lowest score there is.
    low = min(m.get_score(i) for i in range(m.get_piece_size()))
    vocab = [(m.id_to_piece(i), low if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) else m.get_score(i)) for i in range(m.get_piece_size())]
    count = token_count.Counter(token_count.load(path))
    whole = Tokenizer(Unigram(vocab, unk_id=0, byte_fallback=True))
    for t in [t for _, t in texts[:60]] + [t for t in ODD if t and "<" not in t]:
        marked = "▁" + t.replace(" ", "▁")
        ids = whole.encode(marked, add_special_tokens=False).ids
        assert int(count(t).imag) == len(ids), t[:80]


def test_counts_ties_and_brute_force():
    vocab = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0)]
    count = token_count.Counter(vocab)
    assert count("ab") == complex(-3, 2)  # ▁, ab: the longer piece wins the tie
    assert count("aba") == complex(-4, 2)
    assert count(None) == count("") == complex(-1, 1)
    assert count("é").imag == 3  # ▁ and two bytes


def test_count_rows(odd_docs, no_docs):
    path = P.path("piece_bpe_32k.model")
    assert token_count.token_counts(no_docs, path).count() == 0
    assert token_count.token_counts(odd_docs, path).count() == len(ODD) + 2


def expected_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_by_word_equals_whole_texts(texts):
    encode = token_store.Encoder(P.path("word_bpe_49k.json"), 1)
    some = [t for _, t in texts[:50]] + ODD + ["á e ́x", "İstanbul ΑΣ Σ", "' s 's don ' t"]
    for t, raw in zip(some, encode(some), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == expected_ids(t), t and t[:60]


def test_memos_are_bounded_and_lose_nothing(texts, monkeypatch):
    monkeypatch.setattr(token_store, "MEMO", 20_000)
    encode = token_store.Encoder(P.path("word_bpe_49k.json"), 1)
    for s in range(0, 40, 4):
        some = [t for _, t in texts[s : s + 4]]
        assert [np.frombuffer(x, "<u2").tolist() for x in encode(some)] == [expected_ids(t) for t in some]
    assert encode.words.old and encode.pieces.old


def test_store_round_trip(spark, odd_docs, no_docs, texts, tmp_path):
    folder = f"file://{tmp_path}/odd"
    token_store.write(odd_docs, P.path("word_bpe_49k.json"), 1, folder)
    rows = token_store.read(spark, folder).collect()
    assert sorted(r.start for r in rows) == [r.start for r in sorted(rows, key=lambda r: r.start)]
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)][0] is None
    token_store.write(no_docs, P.path("word_bpe_49k.json"), 1, f"file://{tmp_path}/none")
    assert token_store.read(spark, f"file://{tmp_path}/none").count() == 0


def test_store_query(spark, texts):
    got = {r.doc_id: r for r in q_tokens.op2_token_store(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for i, t in sorted(texts):
        ids = expected_ids(t)
        assert (got[i].start, got[i].n_tokens) == (at, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_fetch_one_document(spark, texts, tmp_path):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    token_store.write(docs, P.path("word_bpe_49k.json"), 1, f"file://{tmp_path}/x")
    for i, t in texts[:3]:
        assert token_store.fetch(spark, f"file://{tmp_path}/x", i) == expected_ids(t)


def test_hash_of_dictionary_is_checked(spark, texts, tmp_path):
    docs = spark.createDataFrame(texts[:40], "doc_id long, text string")
    folder = f"file://{tmp_path}/h"
    token_store.write(docs, P.path("word_bpe_49k.json"), 1, folder)
    head = spark.read.parquet(f"{folder}/dictionary").first()
    assert len(head.dictionary) > 0 and head.sha256 == hashlib.sha256(bytes(head.dictionary)).hexdigest()
