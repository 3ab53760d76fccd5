"""Token ids on disk: one zstandard frame per document under a shared dictionary.

Encoding is the tokenizers library's, with its default handling of special strings
in texts; memos of bounded size keep the ids of recent words (see Encoder).

Format, all of it tables written by Spark into one folder:

* ``dictionary``  one row: the dictionary, its sha256, the width of an id in bytes
* ``blocks``      part, block, start_in_part, dictionary sha256, doc_ids, offsets
  (count + 1 of them), n_tokens, blob. A document is ``blob[offsets[i]:offsets[i + 1]]``,
  one frame, readable alone. Parts are ranges of doc_id in ascending order, blocks
  follow each other in a part; ``start_in_part`` counts the ids of the part before.
* ``parts``       part, start: ids of all earlier parts

The dictionary is trained on the ids of at most SAMPLE documents of at most
SAMPLE_CHARS characters, those whose hashed doc_id is least; all documents are
encoded with it. Below 16 sample documents there is none.

Defined cases: null text: empty, so the end id alone; null doc_id: before all
others; equal doc_ids: by text; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 20_000, 65_536
BLOCK_BYTES, BLOCK_DOCS, LEVEL = 4 << 20, 4096, 3
#: Bytes of each of two memos in a Python worker (twice as many while the older half is kept); an entry takes so many besides its key and value.
MEMO, ENTRY = 48 << 20, 180
#: Letters of Latin-1 that are one letter in lower case; words of them and of printable ASCII alone.
LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
SIMPLE = re.compile(f"[!-~{LATIN}]+").fullmatch


class Recent:
    """Values by key. Beyond ``most`` bytes of keys and values the older half goes, so memory is bounded whatever the keys are."""

    def __init__(self, most: int):
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def missing(self, keys: set) -> list:
        """The keys without a value; all others are in ``young`` until the next call."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        new, get = [], self.old.get
        for k in keys - self.young.keys():
            v = get(k)
            if v is None:
                new.append(k)
            else:
                self.add(k, v)
        return new

    def add(self, key, value) -> None:
        self.young[key] = value
        self.size += len(key) + len(value) + ENTRY


class Encoder:
    """Ids of a text as little-endian bytes of ``width`` each, the end id last.

    The library encodes whole texts that hold one of its added tokens. In others its
    normalizer and pattern never join characters across ASCII white space, so a
    text's ids are those of its words in turn. Words of printable ASCII and Latin-1
    letters (lower case and composition are the same for them everywhere) are cut
    into pieces by the file's own pattern, and the pieces that are new go through the
    library's model, many at a time: the last id of a piece marks its end. Other
    words go through the whole tokenizer. Files of any other build are encoded text
    by text.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        self.end = end_id.to_bytes(self.width, "little")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        with open(path, encoding="utf-8") as f:
            built = json.load(f)
        pattern = word_pattern(built)
        self.by_word = pattern is not None
        if pattern is not None:
            self._by_pieces(pattern, built["model"]["end_of_word_suffix"])

    def _by_pieces(self, pattern: str, suffix: str) -> None:
        import numpy as np
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.find = regex.compile(pattern + r"|\n").findall
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in LATIN})
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.words, self.pieces = Recent(MEMO), Recent(MEMO)

    def pack(self, ids: list[int]) -> bytes:
        a = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def learn_pieces(self, pieces: set[str]) -> None:
        import numpy as np

        new, add, width = self.pieces.missing(pieces), self.pieces.add, self.width
        for s in range(0, len(new), 1024):
            some = new[s : s + 1024]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some).translate(self.letters)], add_special_tokens=False)[0].ids)
            at = (np.flatnonzero(self.ends[ids]) + 1) * width
            if len(at) != len(some):
                raise ValueError("a piece doesn't end with the mark of a word's end")
            raw, start = ids.astype(f"<u{width}").tobytes(), 0
            for k, end in zip(some, at.tolist(), strict=True):
                add(k, raw[start:end])
                start = end

    def learn_words(self, words: set[bytes]) -> None:
        simple, texts, add = [], [], self.words.add
        for w in self.words.missing(words):
            t = w.decode("utf-8", "replace")
            if SIMPLE(t) is None:
                add(w, self.whole(t))
            else:
                simple.append(w)
                texts.append(t)
        if not simple:
            return
        cut = self.find("\n".join(texts).lower())
        self.learn_pieces(set(cut) - {"\n"})
        code, start = self.pieces.young, 0
        for w in simple:
            end = cut.index("\n", start) if w is not simple[-1] else len(cut)
            add(w, code[cut[start]] if end == start + 1 else b"".join(map(code.__getitem__, cut[start:end])))
            start = end + 1

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [None if not self.by_word or self.added and self.added.search(t or "") else (t or "").encode("utf-8", "replace").split() for t in texts]
        if self.by_word:
            self.learn_words(set().union(*(words for words in split if words)))
            code = self.words.young.__getitem__
        return [(self.whole(t or "") if words is None else b"".join(map(code, words))) + self.end for t, words in zip(texts, split, strict=True)]


def word_pattern(built: dict) -> str | None:
    """The pattern of words in a tokenizer file, if it is built as the class above needs it."""
    kinds = [n["type"] for n in (built.get("normalizer") or {}).get("normalizers", [])]
    steps = (built.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or built["normalizer"]["normalizers"][1]["pattern"] != {"Regex": r"\s+"} or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
        return None
    split, level = steps
    if (split["behavior"], split["invert"], level["add_prefix_space"], level["use_regex"]) != ("Removed", True, False, False):
        return None
    return split["pattern"].get("Regex")


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One for all tasks of a Python worker, so that its memo outlives them."""
    return Encoder(path, end_id)


def _codec(dictionary: bytes):
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known), zstandard.ZstdDecompressor(dict_data=known)


def train(docs: DataFrame, path: str, end_id: int) -> bytes:
    import zstandard

    short = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", F.xxhash64("doc_id").alias("h"))
    ids = [r.doc_id for r in short.orderBy("h", "doc_id").limit(SAMPLE).collect()]
    if len(ids) < 16:
        return b""
    texts = docs.where(F.col("doc_id").isin(ids) & (F.length("text") <= SAMPLE_CHARS)).orderBy("doc_id", "text").limit(SAMPLE).select("text").collect()
    samples = Encoder(path, end_id)([r.text for r in texts])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> None:
    """Encode every text of ``docs`` and write the three tables into ``folder``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    dictionary = train(docs, tokenizer, end_id)
    sha = hashlib.sha256(dictionary).hexdigest()
    width = Encoder(tokenizer, end_id).width
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches):
        import pyarrow as pa

        encode, (pack, _) = encoder(tokenizer, end_id), _codec(dictionary)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids, sizes, counts, frames, room = [], [], [], [], 0

        def row():
            offsets = [0]
            for s in sizes:
                offsets.append(offsets[-1] + s)
            cols = ([part], [block], [start], [sha], [ids], [offsets], [counts], [b"".join(frames)])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "block", "start_in_part", "dictionary_sha256", "doc_ids", "offsets", "n_tokens", "blob"])

        for b in batches:
            for s in range(0, b.num_rows, 512):
                some = b.slice(s, 512)
                for i, raw in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    frame = pack.compress(raw)
                    ids.append(i)
                    sizes.append(len(frame))
                    counts.append(len(raw) // width)
                    frames.append(frame)
                    room += len(frame)
                    if room >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                        yield row()
                        start, block = start + sum(counts), block + 1
                        ids, sizes, counts, frames, room = [], [], [], [], 0
        if ids:
            yield row()

    schema = "part int, block int, start_in_part long, dictionary_sha256 string, doc_ids array<long>, offsets array<long>, n_tokens array<long>, blob binary"
    in_order.mapInArrow(blocks, schema).write.parquet(f"{folder}/blocks")
    spark.createDataFrame([(bytearray(dictionary), sha, width)], "dictionary binary, sha256 string, width int").write.parquet(f"{folder}/dictionary")
    sums = spark.read.parquet(f"{folder}/blocks").select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sorted((r.part, r.n) for r in sums.groupBy("part").agg(F.sum("n").alias("n")).collect())  # as many rows as parts
    starts, run = [], 0
    for p, k in parts:
        starts.append((p, run))
        run += k
    spark.createDataFrame(starts, "part int, start long").write.parquet(f"{folder}/parts")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document in ``folder``."""
    head = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary, sha, width = bytes(head.dictionary), head.sha256, head.width
    if hashlib.sha256(dictionary).hexdigest() != sha:
        raise ValueError("the dictionary doesn't have its hash")
    starts = {r.part: r.start for r in spark.read.parquet(f"{folder}/parts").collect()}  # as many rows as parts

    def unpack(batches):
        import numpy as np
        import pyarrow as pa

        _, codec = _codec(dictionary)
        for b in batches:
            for r in b.to_pylist():
                if r["dictionary_sha256"] != sha:
                    raise ValueError("a block was packed with another dictionary")
                at = starts[r["part"]] + r["start_in_part"]
                for s in range(0, len(r["doc_ids"]), 256):
                    cols = [], [], [], []
                    for k in range(s, min(s + 256, len(r["doc_ids"]))):
                        raw = codec.decompress(r["blob"][r["offsets"][k] : r["offsets"][k + 1]])
                        ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                        for c, v in zip(cols, (r["doc_ids"][k], at, r["n_tokens"][k], ids), strict=True):
                            c.append(v)
                        at += r["n_tokens"][k]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def fetch(spark: SparkSession, folder: str, doc_id: int) -> list[int]:
    """The ids of one document, from its block alone."""
    import numpy as np

    head = spark.read.parquet(f"{folder}/dictionary").first()
    blocks = spark.read.parquet(f"{folder}/blocks").where(F.array_contains("doc_ids", doc_id))
    k = F.array_position("doc_ids", doc_id)
    at = F.element_at("offsets", k.cast("int"))
    row = blocks.select(F.substring("blob", (at + 1).cast("int"), (F.element_at("offsets", (k + 1).cast("int")) - at).cast("int")).alias("frame")).first()
    raw = _codec(bytes(head.dictionary))[1].decompress(bytes(row.frame))
    return np.frombuffer(raw, f"<u{head.width}").tolist()


def digest(stored: DataFrame) -> DataFrame:
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
