"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's own pattern; each match is a word. Every distinct
word of the whole table is folded once, by Spark's higher-order functions: a word
starts as the ids of its bytes, and a fold over them merges the pair of least rank (in
long words, all pairs of that rank at once) until no pair has a rank. Ranks of pairs
come from a literal map, an array of packed (left, right, merged) with a collision-free
hash.

Merging all pairs of least rank in one step equals merging the leftmost one each
time, if every token of the rank file is reached from its own bytes by merges of
no greater rank (:func:`is_ordered`; all files made by training are so): then no
merge can give a pair of a lesser rank, and all pairs that give one token are the
same two ids. They overlap only in runs of one id, where every other pair from the
left is taken. A word takes one step for each distinct token that it makes, each in
time linear in its length, so a run of 200,000 equal letters takes 17 steps or so.

The ids go back to the documents in two ways, at any size of the corpus:

* at most MOST_WORDS of the most frequent words (from a histogram of counts over the
  whole table), each of at most WORD_BYTES, are broadcast: that bounds the broadcast;
* all others are joined: (document, word) pairs meet the folded words by word. Such
  a word can't be a hot key, as MOST_WORDS others are more frequent, or it is long.
  A document's list of their ids, in the order of its text, meets it by 128 bits.
  Texts move to their lists as zstandard frames, and lists are put together before
  that, so that their shuffles and those of the texts don't lie on disk at once.

Decoding concatenates the binary pieces of the ids.

Defined cases: null text: empty; empty text: no ids; null doc_id and repeated rows:
each row is encoded; very long texts and words: whole, a word is one row; ties:
pairs of one rank are the same token, the left one is merged first; empty table: no
rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spokes.storage import drop_saved, release, save

#: Sizes of the map, and the mark of an empty slot.
SLOTS, BUCKETS, MOST_SHIFT, EMPTY = 200_003, 65_521, 32_768, 1 << 50
NONE, BASE = 1 << 16, 256
#: Words of up to so many bytes are merged one pair at a time, longer ones all equal pairs at a time.
SHORT = 48
#: Bounds of the broadcast words, and of the memos and counts in Python workers; rows of words a partition.
MOST_WORDS, WORD_BYTES, MEMO, COUNTED, CHUNKS = 3 << 18, 64, 300_000, 600_000, 32


@lru_cache(maxsize=1)
def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left << 16 | right) to merged, for every cut of a token into two tokens."""
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids of more than 16 bits")
    out = {}
    for token, merged in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                out[a << 16 | b] = merged
    return out


def is_ordered(ranks: dict[bytes, int]) -> bool:
    """Whether each token is reached from its bytes, by merges of ranks that don't exceed its own."""
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            least, at = min((ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if least > rank:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


def place(table: dict[int, int]) -> tuple[list[int], list[int]]:
    """A hash without collisions: key sits at key % SLOTS + shift[key % BUCKETS] of the first list, as key << 16 | merged."""
    buckets: dict[int, list[int]] = {}
    for key in table:
        buckets.setdefault(key % BUCKETS, []).append(key)
    slots, shift = [EMPTY] * (SLOTS + MOST_SHIFT), [0] * BUCKETS
    for at, keys in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
        for d in range(MOST_SHIFT):
            if all(slots[k % SLOTS + d] == EMPTY for k in keys):
                break
        else:
            raise ValueError("the map is too full")
        shift[at] = d
        for k in keys:
            slots[k % SLOTS + d] = k << 16 | table[k]
    return slots, shift


def rank_map(spark: SparkSession, path: str) -> DataFrame:
    """zero, map (slots, shift): one row. Ids in the map's keys are moved by BASE."""
    import pyarrow as pa

    ranks = load(path)
    if BASE + max(ranks.values()) >= 0xD800:
        raise ValueError("ids beyond the characters that can stand for them")
    of = lambda k: ((k >> 16) + BASE) << 16 | (k & 0xFFFF) + BASE
    slots, shift = place({of(k): v for k, v in pairs(ranks).items()})
    one = pa.table({"zero": pa.array([0], pa.int64()), "slots": pa.array([slots], pa.list_(pa.int64())), "shift": pa.array([shift], pa.list_(pa.int64()))})
    return save(spark.createDataFrame(one).select("zero", F.struct("slots", "shift").alias("map")), "ranks")


def _bind(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _rank(pair: Column, table: Column) -> Column:
    """A slot holds its pair above its rank, so that XOR with the pair leaves the rank alone, or NONE or more where the pair has none."""
    return F.get(table["slots"], pair % SLOTS + F.get(table["shift"], pair % BUCKETS)).bitwiseXOR(F.shiftleft(pair, 16))


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 16).bitwiseOR(b)


def _least(ranks: Column) -> Column:
    """The least rank and its first position, in one number; null if there is no rank."""
    return F.array_min(F.transform(ranks, lambda r, i: F.when(r < NONE, F.shiftleft(r, 32).bitwiseOR(i))))


def _fold_short(start: Column, table: Column) -> Column:
    """One merge a step, that of the least pair; the state keeps the ranks, as a merge changes two of them, and the least of them."""
    none = F.array().cast("array<bigint>")

    def state(ids: Column, ranks: Column) -> Column:
        return _bind(ranks, lambda r: F.struct(ids.alias("ids"), r.alias("ranks"), _least(r).alias("least")))

    def merge(s: Column) -> Column:
        ids, ranks, p, one = s["ids"], s["ranks"], s["least"].bitwiseAND(0x7FFFFFFF).cast("int"), F.shiftright(s["least"], 32) + BASE
        before = F.when(p > 0, F.array(_pair(F.get(ids, p - 1), one))).otherwise(none)
        after = F.when(p + 1 < F.size(ranks), F.array(_pair(one, F.get(ids, p + 2)))).otherwise(none)
        return state(
            F.concat(F.slice(ids, 1, p), F.array(one), F.slice(ids, p + 3, F.size(ids))),
            F.concat(F.slice(ranks, 1, F.greatest(p - 1, F.lit(0))), F.transform(F.concat(before, after), lambda k: _rank(k, table)), F.slice(ranks, p + 3, F.size(ids))),
        )

    def folded(ids: Column) -> Column:
        n = F.size(ids)
        ranks = F.transform(F.zip_with(F.slice(ids, 1, n - 1), F.slice(ids, 2, n - 1), _pair), lambda k: _rank(k, table))
        step = lambda s, _: F.when(s["least"].isNull(), s).otherwise(merge(s))
        return F.aggregate(F.sequence(F.lit(1), n - 1), state(ids, ranks), step, lambda s: F.transform(s["ids"], lambda x: (x - BASE).cast("int")))

    return F.when(F.length(start) > 1, _bind(F.transform(F.split(start, ""), lambda c: F.ascii(c).cast("long")), folded)).otherwise(F.array(F.ascii(start) - BASE))


def _fold_long(start: Column, table: Column) -> Column:
    """All merges of the least pair in a step; the state is a string of ids, so that they are one replacement from the left."""
    state = lambda ids, done: F.struct(ids.alias("ids"), F.lit(done).alias("done"))

    def merge(s: Column) -> Column:
        def least(ids: Column) -> Column:
            pairs_of = F.transform(ids, lambda x, i: _pair(F.ascii(x), F.ascii(F.get(ids, i + 1))))  # the last one has no neighbour: null
            return _bind(_least(F.transform(pairs_of, lambda k: _rank(k, table))), lambda m: replaced(ids, m))

        def replaced(ids: Column, m: Column) -> Column:
            at = m.bitwiseAND(0x7FFFFFFF).cast("int")
            both = F.concat(F.get(ids, at), F.get(ids, at + 1))
            one = F.decode(F.unhex(F.lpad(F.hex(F.shiftright(m, 32) + BASE), 4, "0")), "UTF-16BE")
            return F.when(m.isNull(), state(s["ids"], True)).otherwise(state(F.replace(s["ids"], both, one), False))

        return _bind(F.split(s["ids"], ""), least)

    # Two levels of steps, as a finished word is still copied in each step that is left.
    steps = F.sequence(F.lit(1), F.ceil(F.sqrt(F.length(start))).cast("int"))
    more = lambda f: lambda s, _: F.when(s["done"], s).otherwise(f(s))
    return F.aggregate(
        steps, state(start, False), more(lambda s: F.aggregate(steps, s, more(merge))), lambda s: F.transform(F.split(s["ids"], ""), lambda c: F.ascii(c) - BASE)
    )


def fold(word: Column, ranks: Column, path: str) -> Column:
    """array<int>: ids of one word of a byte or more, by ``ranks``, the column ``map`` of :func:`rank_map`. Ids are carried as characters or numbers of BASE + id."""
    known = load(path)
    latin = F.translate(F.decode(word.cast("binary"), "ISO-8859-1"), "".join(map(chr, range(256))), "".join(chr(BASE + known[bytes([b])]) for b in range(256)))
    return _bind(ranks, lambda table: _bind(latin, lambda x: F.when(F.length(x) <= SHORT, _fold_short(x, table)).otherwise(_fold_long(x, table))))


SPACED, CUT, SIGNS = re.compile(r" (?<=\s )"), re.compile(r"(?<=\S) "), tuple(".,;:!?")


def segments(text: str) -> list[str]:
    """``text`` cut at the spaces after characters that aren't white space.

    No match of the pattern has white space after other characters, and it looks
    ahead only from white space, so each segment (with its space, but for the first)
    is cut into words alone.
    """
    return CUT.split(text) if SPACED.search(text) else text.split(" ")


class Words:
    """Cuts texts into words by the pattern."""

    def __init__(self):
        import public_tokenizers
        import regex

        self.find = regex.compile(public_tokenizers.PATTERN).findall

    def cut(self, lead: str, segment: str) -> tuple | list:
        """The words of ``lead + segment``; letters alone, or with one sign at the end, don't need the pattern."""
        if segment.isalpha():
            return (lead + segment,)
        if segment.endswith(SIGNS) and segment[:-1].isalpha():
            return lead + segment[:-1], segment[-1]
        return self.find(lead + segment)

    def count(self, texts, most: int):
        """Yields dicts of counts of words, none over ``most`` distinct segments and a text."""
        from collections import Counter

        first, rest = Counter(), Counter()

        def flush():
            out: dict[str, int] = {}
            for lead, some in (("", first), (" ", rest)):
                for s, n in some.items():
                    for w in self.cut(lead, s):
                        out[w] = out.get(w, 0) + n
                some.clear()
            return out

        for t in texts:
            s = segments(t or "")
            first[s[0]] += 1
            rest.update(s[1:])
            if len(rest) + len(first) >= most:
                yield flush()
        yield flush()


class Coder(Words):
    """Ids of texts as little-endian unsigned 32-bit numbers, from the broadcast words and each text's own list."""

    def __init__(self, table):
        super().__init__()
        self.codes = {}
        for s in range(0, table.num_rows, 65_536):
            part = table.slice(s, 65_536)
            self.codes.update(zip(part.column("word").to_pylist(), part.column("code").to_pylist(), strict=True))
        self.memo: dict[str, bytes] = {}

    def missing(self, text: str) -> list[str]:
        """The distinct words that aren't broadcast, in the order of the text."""
        out, memo, codes = {}, self.memo, self.codes
        s = segments(text)
        for w in self.cut("", s[0]):
            if w not in codes:
                out[w] = None
        for seg in dict.fromkeys(s[1:]):
            if seg not in memo:
                words = self.cut(" ", seg)
                new = [w for w in words if w not in codes]
                if new:
                    out.update(dict.fromkeys(new))
                else:
                    self.keep(seg, words)
        return list(out)

    def keep(self, key: str, words) -> None:
        if len(key) <= WORD_BYTES:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[key] = self.codes[words[0]] if len(words) == 1 else b"".join(map(self.codes.__getitem__, words))

    def encode(self, text: str, own: dict[int, bytes]) -> bytes:
        """``own``: codes of the missing words by their number in the order of the text."""
        memo, codes, seen, out = self.memo, self.codes, {}, []
        add = out.append

        def of(words):
            for w in words:
                code = codes.get(w)
                add(own[seen.setdefault(w, len(seen))] if code is None else code)

        s = segments(text)
        of(self.cut("", s[0]))
        for x in s[1:]:
            code = memo.get(x)
            if code is None:
                words = self.cut(" ", x)
                if all(w in codes for w in words):
                    self.keep(x, words)
                of(words)
            else:
                add(code)
        return b"".join(out)


_coders: dict[str, Coder] = {}


def _coder(sent) -> Coder:
    """One for all tasks of a Python worker; another broadcast takes its place."""
    name, blob = sent.value
    if name not in _coders:
        import pyarrow as pa

        _coders.clear()
        _coders[name] = Coder(pa.ipc.open_stream(blob).read_all())
    return _coders[name]


def _count(docs: DataFrame) -> DataFrame:
    """word, n, as each task adds them up."""

    def run(batches):
        import pyarrow as pa

        def texts():
            for b in batches:
                for s in range(0, b.num_rows, 256):
                    yield from b.column(0).slice(s, 256).to_pylist()

        for counts in Words().count(texts(), COUNTED):
            words, n = list(counts), list(counts.values())
            for s in range(0, len(words), 16_384):
                yield pa.RecordBatch.from_arrays([pa.array(words[s : s + 16_384], pa.string()), pa.array(n[s : s + 16_384], pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long")


def fold_words(counts: DataFrame, path: str) -> DataFrame:
    """word, n, code (packed ids) of the distinct words of ``counts`` (word, n), each folded once.

    Words come in CHUNKS rows a partition, each of which meets the one row of the rank
    map. As text in the plan, the map would take megabytes in every description of it.
    """
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.withColumn("chunk", F.pmod(F.xxhash64("word"), F.lit(CHUNKS * parts))).repartition(parts, "chunk")
    chunks = dealt.groupBy("chunk", "word").agg(F.sum("n").alias("n")).groupBy("chunk").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    both = chunks.select((F.col("chunk") - F.col("chunk")).alias("zero"), "words").join(F.broadcast(rank_map(spark, path)), "zero")
    code = lambda x: F.struct(x["word"].alias("word"), x["n"].alias("n"), _packed(fold(x["word"], F.col("map"), path)).alias("code"))
    return both.select(F.inline(F.transform("words", code)))


def _frequent(words: DataFrame) -> Column:
    """The condition that at most MOST_WORDS of the most frequent words meet; a bin is an eighth of a power of two."""
    bin_, short = F.floor(F.log2("n") * 8), F.octet_length("word") <= WORD_BYTES
    sizes = words.where(short).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect()  # at most 512 rows
    least, room = 1 << 20, MOST_WORDS
    for r in sorted(sizes, key=lambda r: -r.bin):
        if r.n > room:
            break
        least, room = r.bin, room - r.n
    return short & (bin_ >= least)


def _packed(ids: Column) -> Column:
    """Ids of under 2 ** 16 as little-endian unsigned 32-bit numbers."""
    little = lambda i: F.concat(F.substring(F.hex(i + (1 << 16)), 4, 2), F.substring(F.hex(i + (1 << 16)), 2, 2), F.lit("0000"))
    return F.unhex(F.array_join(F.transform(ids, little), ""))


def _encoded(docs: DataFrame, path: str, rows, schema: str) -> DataFrame:
    """``rows()`` gives, once a task, a function from lists of doc_ids and of packed ids to the columns of ``schema``."""
    import uuid

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = save(fold_words(_count(docs), path), "words")
    release(spark)
    often = _frequent(words)
    table = words.where(often).select("word", "code").toArrow()  # at most MOST_WORDS rows of bounded length
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    del table
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, sink.getvalue().to_pybytes()))
    del sink

    # 128 bits, and the order of a text's words: so the words themselves don't come along to the documents.
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2"), "doc_id", "text")

    def missing(batches):
        coder = _coder(sent)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                some = b.slice(s, 256)
                at, number, found = [], [], []
                for i, t in enumerate(some.column(2).to_pylist()):
                    new = coder.missing(t)
                    at += [i] * len(new)
                    number += range(len(new))
                    found += new
                at = pa.array(at, pa.int32())
                cols = [some.column(0).take(at), some.column(1).take(at), pa.array(number, pa.int32()), pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "number", "word"])

    rest = keyed.select("k1", "k2", "text").mapInArrow(missing, "k1 long, k2 long, number int, word string")
    rest = rest.join(words.where(~often).select("word", "code"), "word")
    lists = rest.groupBy("k1", "k2").agg(F.collect_set(F.struct("number", "code")).alias("own"))
    lists = save(lists.select("k1", "k2", F.col("own.number").alias("numbers"), F.col("own.code").alias("codes")), "lists")
    drop_saved(words)
    del rest, words
    release(spark)

    def framed(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for s in range(0, b.num_rows, 256):
                some = b.slice(s, 256)
                frames = [compress(t) for t in some.column(3).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(frames, pa.binary())], names=["k1", "k2", "doc_id", "frame"])

    frames = keyed.select("k1", "k2", "doc_id", "text").mapInArrow(framed, "k1 long, k2 long, doc_id long, frame binary")
    both = frames.join(lists, ["k1", "k2"], "left").select("doc_id", "frame", "numbers", "codes")
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def coded(batches):
        import zstandard

        coder, make, whole = _coder(sent), rows(), zstandard.ZstdDecompressor().decompress
        for b in batches:
            for s in range(0, b.num_rows, 128):
                ids, *cols = [c.to_pylist() for c in b.slice(s, 128).columns]
                packed = [coder.encode(whole(f).decode(), dict(zip(n or (), c or (), strict=True))) for f, n, c in zip(*cols, strict=True)]
                yield pa.RecordBatch.from_pydict(make(ids, packed), schema=arrow)

    return both.mapInArrow(coded, schema)


def _numbers(packed: list[bytes]):
    """Packed ids as one Arrow array of lists."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""
    return _encoded(docs, path, lambda: lambda ids, packed: {"doc_id": ids, "ids": _numbers(packed)}, "doc_id long, ids array<int>")


@lru_cache(maxsize=1)
def _pieces(path: str) -> list[bytes]:
    by_id = {i: b for b, i in load(path).items()}
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


def decode(ids, path: str) -> bytes:
    """The bytes of the ids' pieces in turn."""
    return b"".join(map(_pieces(path).__getitem__, ids))


def encode_with_digest(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes decoded from the ids), and the ids on request."""

    def rows():
        import numpy as np

        def of(doc_ids, packed):
            out = {
                "doc_id": doc_ids,
                "n_tokens": [len(x) // 4 for x in packed],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in packed],
                "decoded_sha256": [hashlib.sha256(decode(np.frombuffer(x, "<u4").tolist(), path)).hexdigest() for x in packed],
            }
            return out | ({"ids": _numbers(packed)} if keep_ids else {})

        return of

    return _encoded(docs, path, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
