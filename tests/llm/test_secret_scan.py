import hashlib
import math
import random
import re

import public_tokenizers as P

from spokes.llm import secret_scan as S

from .conftest import ODD

WORDS = S.ranks(P.path("word_bpe_49k.json"))


def brute(text):
    """The contract's patterns as they are written, letters of the names in either case."""
    out = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


CASES = [
    'é password = "abcdef1" token:short token=token: abcdefgh API_KEY=x1y2z3',
    "AKIA" + "A" * 16 + " AKIAAKIA1 " + "0a" * 12 + " deadbeef",
    "secret=token=abcdef apikey='....//'",
    "PassWd:" + "f" * 30,
]


def test_base_spans_equal_the_patterns(texts):
    for t in CASES + [t for _, t in texts] + [t for t in ODD if t]:
        assert S.ordered(S.base_spans(t)) == brute(t)


def test_guess_cost():
    weak = ["password", "changeme", "aaaaaaaa", "qwertyuiop", "12345678", "passwordpassword", "P4ssword", "20240131", "qwertyuiopassword", "asdfghjkletmein", "springtime", "abcabcabcabc"]
    strong = ["x9$Lq2!vTz8", "hG7kPq2mZr4w", "j38fh2kd9s0a1l"]
    assert max(S.guess_cost(w, WORDS) for w in weak) < S.STRONG <= min(S.guess_cost(w, WORDS) for w in strong)
    assert S.guess_cost("", WORDS) == 0
    assert len(WORDS) > 10_000 and WORDS["password"] == 1
    for long in ("ab" * 50_000, "qw" * 50_000, "x9$" * 30_000):  # long values take linear time
        assert S.guess_cost(long, WORDS) > 0


def segment(v, words):
    """The least cost of the whole of ``v`` as one segment, each kind by its definition."""
    n, low = len(v), S.lower(v)
    out = [float(n)]
    for form in {low, low.translate(S.LEET)}:
        if n >= 3 and form in words:
            out.append(math.log10(words[form] + 1) + S.SEGMENT * ((v != low) + (form != low)))
    if S.YEAR.fullmatch(v) or any(d.fullmatch(v) for d in S.DATES):
        out.append(S.date_cost(v))
    for u in range(1, S.UNIT + 1):
        if n % u == 0 and n // u >= S.COPIES and v == v[:u] * (n // u):
            out.append(u + S.AGAIN * (n // u - 1))
    ways = [S.NEXT.get(p) for p in zip(low, low[1:])]
    if n >= S.WALK and all(ways):
        out.append(S.START + S.STRAIGHT + sum(S.STRAIGHT if a == b else S.TURN for a, b in zip(ways, ways[1:])))
    return min(out) + S.SEGMENT


def test_guess_cost_equals_brute_force():
    """All cuts of values that mix words, dates, repeats, walks and other characters."""
    words = {w: r for w, r in WORDS.items() if r < 3000}
    rng = random.Random(3)
    parts = ["password", "P4ss", "the", "2024", "1999-12-31", "31.12.1999", "20122012", "aaaa", "abab", "xyzxyzxyz", "qwer", "fdsa", "12345", "zx", "K", "9", "$", "é", "İ", "poiuytr", "dragon"]
    values = ["qwertyuiopassword", "asdfghjkletmein", "aaaaaaab", "abcabcabcab", "", "x"]
    for _ in range(150):
        v = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        values.append("".join(c for c in v if rng.random() > 0.06))
    for v in values:
        best = [0.0]
        for j in range(1, len(v) + 1):
            best.append(min(best[i] + segment(v[i:j], words) for i in range(j)))
        assert abs(S.guess_cost(v, words) - best[-1]) < 1e-9, v


def test_rows(spark, odd_docs, no_docs):
    assert S.scan(no_docs).count() == 0
    rows = S.digest(S.scan(odd_docs)).collect()
    assert len(rows) == len(ODD) + 2
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for r in S.digest(S.scan(docs)).collect():
        base = brute(CASES[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[0] == k for b in base) for k in S.KINDS[:3])


def test_stage_masks_and_keeps_columns(odd_docs, no_docs, spark):
    assert S.stage(no_docs).columns == no_docs.columns
    assert S.stage(odd_docs).count() == odd_docs.count()
    for t in CASES:
        assert not S.base_spans(S.redact(t, WORDS))
    one = spark.createDataFrame([(1, "my password: hunter22zz ok", 26)], "doc_id long, text string, n_chars long")
    assert S.stage(one).first() == (1, "my [SECRET] ok", 14)
