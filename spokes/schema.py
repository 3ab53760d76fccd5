"""Row types and fixed values."""

from __future__ import annotations

SEQ = "struct<phase:int,doc:bigint,chunk:int,pos:bigint>"
TRIPLE = f"subject string, predicate string, object string, chunk int, inferred boolean, seq {SEQ}"

#: Words that may not end a shortened predicate, and words that names are compared without.
TRAILING_STOPS = ["a", "an", "the", "of", "with", "by", "to", "from", "in", "on", "for"]
NAME_STOPS = ["the", "a", "an", "of", "and", "or", "in", "on", "at", "to", "for", "with", "by", "as"]

#: Phases of a triple's ``seq``: read, inferred between and within components, by transitivity, by names.
ORIGINAL, BETWEEN, WITHIN, TRANSITIVE, LEXICAL = range(5)
