"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton gives, for each end, all vocabulary pieces that end
there; a dynamic program carries (best score, piece count) and keeps no lattice.
Ties go to the longest piece, as in unigram tokenizers, where a later start only
replaces an earlier one with a strictly better score. A character that is no
piece costs the lowest score less UNKNOWN and counts one piece for each of its
UTF-8 bytes (byte fallback).

The vocabulary has no piece with the word mark after another character, nor any
multi-character piece with a line feed (checked when it is loaded), so every best
path passes through these boundaries; each stretch between them is solved alone
and remembered. This is exact, and long texts take linear time.

Defined cases: null text: like the empty one; empty text: the word mark alone,
hence one piece; very long texts: whole; null doc_id: counted under null; repeated rows:
each is counted; empty table: no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from spokes.llm._arrow import Memo, map_batches

#: The word mark and the penalty of unknown characters.
MARK, UNKNOWN = "▁", 10.0
STRETCH = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def load(path: str) -> list[tuple[str, float]]:
    """Normal pieces and their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not special(i)]


class Counter:
    """Pieces and best score of a text."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        bad = [p for p, _ in vocabulary if re.search(f"[^{MARK}]{MARK}", p) or len(p) > 1 and "\n" in p]
        if bad:
            raise ValueError(f"pieces cross a word mark or line feed: {bad[:3]}")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN
        #: (score, count) as a complex number: one addition adds both.
        self.memo = Memo(self.solve)

    def solve(self, s: str) -> complex:
        n = len(s)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (size, score) in self.automaton.iter(s):
            found[end + 1].append((size, score))
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            top = None
            for size, score in sorted(found[j], reverse=True):
                if top is None or best[j - size] + score > top:
                    top, count[j] = best[j - size] + score, count[j - size] + 1
            if not found[j] or found[j][-1][0] != 1 and min(found[j])[0] != 1:
                cost = best[j - 1] + self.unknown
                if top is None or cost > top:
                    top, count[j] = cost, count[j - 1] + len(s[j - 1].encode("utf-8", "surrogatepass"))
            best[j] = top
        return complex(best[n], count[n])

    def __call__(self, text: str | None) -> complex:
        marked = MARK + (text or "").replace(" ", MARK)
        return sum(map(self.memo.__getitem__, STRETCH.findall(marked)), 0j)


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One for all tasks of a Python worker, so that its memo outlives them."""
    return Counter(load(path))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pieces and best score of every text; ``vocabulary`` is a path that every executor has."""

    def make():
        count = counter(vocabulary)

        def each(c: dict) -> dict:
            z = [count(t) for t in c["text"]]
            return {"doc_id": c["doc_id"], "n_pieces": [int(x.imag) for x in z], "score": [x.real for x in z]}

        return each

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_pieces long, score double")
