"""Tolerant reading of JSON in model answers (O29-O34), in one Arrow UDF.

The ladder is: the first fenced block, the text as JSON, the first balanced
bracket run, that run repaired, and for an array that breaks off its complete
objects. Brackets are counted without regard to strings, as callers rely on it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
#: The two repairs.
BARE_KEY, KEYED = re.compile(r"(\s*)(\w+)(\s*):(\s*)"), r'\1"\2"\3:\4'
COMMA = re.compile(r",(\s*[\]}])")
RESULT = "kind string, value string, stage string"


def _load(text: str):
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def _runs(text: str, opening: str, closing: str):
    """(start, end) of balanced runs from left to right; end is None for one that is never closed."""
    depth = start = 0
    for at, c in enumerate(text):
        if c == opening:
            if not depth:
                start = at
            depth += 1
        elif c == closing and depth:
            depth -= 1
            if not depth:
                yield start, at + 1
    if depth:
        yield start, None


def _mended(text: str) -> str:
    return COMMA.sub(r"\1", BARE_KEY.sub(KEYED, text))


def read_json(text: str | None):
    """(stage, value): the first rung that parses; stage is None if none does."""
    if text is None:
        return None, None
    fenced = FENCE.search(text)
    body = fenced[1].strip() if fenced else text
    ok, value = _load(body)
    if ok:
        return "strict", value
    at = body.find("[")
    if at < 0:
        return None, None
    _, end = next(_runs(body[at:], "[", "]"))
    if end is not None:
        tries = [("slice", body[at : at + end]), ("repair", _mended(body[at : at + end]))]
    else:
        whole = [body[at:][s:e] for s, e in _runs(body[at:], "{", "}") if e]
        if not whole:
            return None, None
        joined = "[" + ",".join(whole) + "]"
        tries = [("salvage", joined), ("salvage repair", _mended(joined))]
    for stage, candidate in tries:
        ok, value = _load(candidate)
        if ok:
            return stage, value
    return None, None


def _kind(value) -> str:
    return {list: "array", dict: "object", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")


def ladder(text: Column) -> Column:
    """struct<kind, value, stage>: kind of the JSON value, its canonical text in the order it was written, and the rung."""

    @F.arrow_udf(RESULT)
    def run(column):
        import pyarrow as pa

        out = []
        for t in column.to_pylist():
            stage, value = read_json(t)
            out.append({"kind": _kind(value) if stage else None, "value": json.dumps(value) if stage else None, "stage": stage})
        return pa.array(out, pa.struct([("kind", pa.string()), ("value", pa.string()), ("stage", pa.string())]))

    return run(text)


def array_items(answers: DataFrame, column: str = "value") -> DataFrame:
    """Rows of ``answers`` once for each element of the JSON array in ``column``: pos and item (VARIANT)."""
    answers.createOrReplaceTempView("_spokes_answers")
    return answers.sparkSession.sql(f"SELECT a.*, x.pos, x.value AS item FROM _spokes_answers a, LATERAL variant_explode(try_parse_json(a.{column})) x")


def mapping_rows(answers: DataFrame, column: str = "value") -> DataFrame:
    """(ord, standard, variants) of a JSON object of lists, in the order of the text."""

    @F.arrow_udf("array<struct<ord int, standard string, variants array<string>>>")
    def run(texts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("ord", pa.int32()), ("standard", pa.string()), ("variants", pa.list_(pa.string()))]))
        out = []
        for t in texts.to_pylist():
            value = json.loads(t) if t else {}
            rows = value.items() if isinstance(value, dict) else []
            out.append([{"ord": i, "standard": k, "variants": [str(x) for x in v]} for i, (k, v) in enumerate(rows) if isinstance(v, (list, str))])
        return pa.array(out, kind)

    return answers.select(F.inline(run(F.col(column))))
