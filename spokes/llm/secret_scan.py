"""Secret scans: fixed patterns, and a guess-cost dynamic program over values in credential contexts.

A value after a credential word is cut into dictionary words, dates, repeats,
keyboard walks and brute-force spans so that the sum of the segments' log10 guesses
is least over all segmentations. A value that costs STRONG or more is a secret and
adds a span of kind ``guess``; placeholders such as ``changeme`` cost little.

Costs, of which every segment adds SEGMENT:

* word: log10 of its rank and one more; SEGMENT for capitals, SEGMENT for digits and
  signs in place of letters. Ranks: WORDS, then the words of a tokenizer's vocabulary
  file in its order (a parameter), which is about that of their frequency
* date: a year, or day, month and year either way round, with up to two separators
* repeat: COPIES or more of a unit of 1 to UNIT characters: the unit by brute force, AGAIN a copy
* walk: WALK or more neighbours on a keyboard or in the alphabet: START, then STRAIGHT
  or TURN a step
* brute force: one a character

Walks and repeats may start and end anywhere in a run: the program carries the best
open one, so a value of n characters takes O(n) time.

Offsets are code points, ends are exclusive. Defined cases: null text: empty;
empty text: no spans; spans of different kinds may overlap, and at equal starts
stand in the order of KINDS; repeated rows: each is scanned; other columns are
ignored by :func:`scan` and kept by :func:`stage`.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokes.llm._arrow import map_batches

KINDS = ("assign", "access", "hex", "guess")


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base patterns and the least lengths of group 2 or of the match.
NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
ASSIGN = re.compile(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more, as the run pattern and the least length give
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: Credential contexts of the guess cost: more words, and values up to white space or a quote.
CONTEXTS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "credential", "login", "auth")
CONTEXT = re.compile(rf"""(?:{"|".join(map(_any_case, CONTEXTS))})["']?\x20*[:=]\x20*["']?([^\s"'<>,;]+)""")
STRONG = 8.0

#: Common words of passwords, the most common first.
WORDS = (
    "password pass admin welcome monkey dragon letmein master login hello secret token user test guest root "
    "changeme default example sample dummy placeholder none null true false love angel sunshine princess shadow "
    "football baseball soccer hockey michael jordan jessica charlie daniel thomas andrew joshua ashley matthew "
    "robert george hunter killer superman batman trustno flower cookie summer winter spring autumn monday friday "
    "january march april june july august october november december orange purple yellow silver golden black white "
    "green blue red computer internet server system access private public office company money star moon rain "
    "tiger lion eagle horse mustang ferrari mercedes harley yankees lakers london paris berlin your here key value"
).split()
LEET = str.maketrans("013457@$!", "oleastasi")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
#: Directions between neighbours: the row and forwards or backwards.
NEXT = {(x, y): (r, d) for r, row in reversed(list(enumerate(ROWS))) for a, b in zip(row, row[1:], strict=False) for x, y, d in ((a, b, 1), (b, a, -1))}
YEAR = re.compile(r"(?:19|20)\d\d")
DATES = (re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"), re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d"))
SEGMENT = math.log10(2)
COPIES, UNIT, AGAIN = 3, 4, 0.1
WALK, START, STRAIGHT, TURN = 3, math.log10(2 * 47), 0.1, 0.6
LONGEST_WORD = 20


@lru_cache(maxsize=2)
def ranks(path: str | None) -> dict[str, int]:
    """Rank of each dictionary word; without a file, of WORDS alone."""
    out = {w: i + 1 for i, w in enumerate(WORDS)}
    if path:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        for t in sorted(vocabulary, key=vocabulary.get):
            w = t.removesuffix("</w>")
            if w != t and 3 <= len(w) <= LONGEST_WORD and w.isascii() and w.isalpha():
                out.setdefault(w, len(out) + 1)
    return out


def lower(value: str) -> str:
    """In lower case, character by character."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def date_cost(text: str) -> float:
    """log10 of the guesses of a year or a date."""
    year = int(YEAR.search(text[-4:] if YEAR.fullmatch(text[-4:]) and not YEAR.match(text) else text)[0])
    return math.log10(max(abs(year - 2000), 20)) + (math.log10(365) if len(text) > 4 else 0) + (SEGMENT if re.search(r"\D", text) else 0)


def word_cost(rank: int, capital: bool, leet: bool) -> float:
    return math.log10(rank + 1) + SEGMENT * (capital + leet)


def guess_cost(value: str, words: dict[str, int]) -> float:
    """log10 of the guesses of the cheapest segmentation."""
    n, low, inf = len(value), lower(value), math.inf
    plain = low.translate(LEET)
    bounded: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # words and dates by their end
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            for form in {low[i:j], plain[i:j]}:
                if rank := words.get(form):
                    bounded[j].append((i, word_cost(rank, value[i:j] != low[i:j], form != low[i:j])))
        if value[i].isdecimal():
            for m in filter(None, (YEAR.match(value, i), *(d.match(value, i) for d in DATES))):
                bounded[m.end()].append((i, date_cost(m[0])))
    cost, brute = [0.0] * (n + 1), [inf] * (n + 1)  # the best of all, and of those that end in brute force
    pair, walk = [inf] * (n + 1), [inf] * (n + 1)  # open walks of two characters, and of WALK or more
    same = [0] * (UNIT + 1)  # for each unit, how many characters up to here equal those one unit before
    copies = [[inf] * (n + 1) for _ in range(UNIT + 1)]  # open repeats of two copies, and of COPIES or more, by unit
    repeat = [[inf] * (n + 1) for _ in range(UNIT + 1)]
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], cost[j - 1] + SEGMENT) + 1
        best = brute[j]
        for i, c in bounded[j]:
            best = min(best, cost[i] + SEGMENT + c)
        way = NEXT.get((low[j - 2], low[j - 1])) if j > 1 else None
        if way:
            pair[j] = cost[j - 2] + SEGMENT + START + STRAIGHT
            step = STRAIGHT if j > 2 and NEXT.get((low[j - 3], low[j - 2])) == way else TURN
            walk[j] = min(walk[j - 1], pair[j - 1]) + step
            best = min(best, walk[j])
        for u in range(1, UNIT + 1):
            same[u] = same[u] + 1 if j > u and value[j - 1] == value[j - 1 - u] else 0
            if same[u] >= u:
                copies[u][j] = cost[j - 2 * u] + SEGMENT + u + AGAIN
                repeat[u][j] = min(repeat[u][j - u], copies[u][j - u]) + AGAIN
                best = min(best, repeat[u][j])
        cost[j] = best
    return cost[n]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def guess_spans(text: str, words: dict[str, int]) -> list[tuple[str, int, int]]:
    if ":" not in text and "=" not in text:
        return []
    return [("guess", *m.span(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], words) >= STRONG]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and base and all spans of every text, as arrays of (kind, start, end). ``vocabulary``: the file of ranked words."""

    def each(c: dict) -> dict:
        words = ranks(vocabulary)
        base = [ordered(base_spans(t or "")) for t in c["text"]]
        every = [ordered(b + guess_spans(t or "", words)) for b, t in zip(base, c["text"], strict=True)]
        as_rows = lambda x: [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in x]
        return {"doc_id": c["doc_id"], "base": as_rows(base), "spans": as_rows(every)}

    span = "array<struct<kind string, start int, end int>>"
    return map_batches(docs.select("doc_id", "text"), lambda: each, f"doc_id long, base {span}, spans {span}")


def redact(text: str, words: dict[str, int], mask: str = "[SECRET]") -> str:
    """``text`` with each stretch of overlapping or touching spans put as ``mask``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, s, e in ordered(base_spans(text) + guess_spans(text, words)):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def stage(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with secrets in ``text`` put as a mask, and ``n_chars`` of the new text."""

    def each(c: dict) -> dict:
        words = ranks(vocabulary)
        return c | {"text": [None if t is None else redact(t, words) for t in c["text"]]}

    out = map_batches(docs, lambda: each, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the base spans, and all spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


