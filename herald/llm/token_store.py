"""Token-id shards: concatenated ids, document boundaries in Elias-Fano form.

A store is a Parquet table, so that any file system Spark knows can hold it
and its commit protocol makes rewrites and lost executors harmless. A row is a
block of whole documents, ascending by doc_id:

- ``shard``, ``block``: position in the store; blocks sort by the two.
- ``first``: ids in the shard before the block.
- ``n_docs``, ``n_ids``: documents and ids in the block.
- ``ids``: all ids, little-endian, 2 bytes each if the vocabulary allows, else 4 (``width``).
- ``ends``: Elias-Fano code of the documents' end offsets (:class:`EliasFano`).
- ``doc_ids``: the documents' own ids as zlib-compressed differences of 64-bit values; ``has_id`` a bit for each.

Ends ``e_1 <= ... <= e_n <= u`` take about ``2 + log2(u / n)`` bits each: the
low ``l`` bits lie side by side, the high parts are unary in a bit vector.
``select(i)`` finds the i-th one bit by a directory with the position of every
64th one, and so the offset of a document without decoding the others.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from herald.llm._common import text_of

#: Bytes of ids after which a block is closed; a document is never split.
BLOCK_BYTES = 1 << 22
#: Bytes of words that each Python worker remembers the ids of, with what Python adds to each.
CACHE, ENTRY = 160 << 20, 200
#: The rules of a vocabulary file by which a text's ids are those of its parts one after the other. White
#: space is one space and dropped, case is folded, and letters are never joined with other characters but in contractions.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SCHEMA = "shard int, block int, first long, n_docs long, n_ids long, width int, ids binary, ends binary, doc_ids binary, has_id binary"


class EliasFano:
    """A non-decreasing sequence of integers, with random access."""

    SAMPLE = 64

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.l, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        l = max(0, int(math.floor(math.log2(top / n)))) if n and top > n else 0
        bits = ((v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, l, low, np.packbits(unary, bitorder="little"), ones[:: cls.SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.l, len(self.low), len(self.high)], "<u4")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, l, a, b = (int(x) for x in np.frombuffer(data, "<u4", 4))
        return cls(
            n, l, np.frombuffer(data, np.uint8, a, 16), np.frombuffer(data, np.uint8, b, 16 + a), np.frombuffer(data, "<u4", -1, 16 + a + b)
        )

    def select(self, i: int) -> int:
        """The i-th value, from 0: reads the unary bits after the nearest sample only."""
        at, left = int(self.samples[i // self.SAMPLE]), i % self.SAMPLE
        first = at // 8
        skip = at - first * 8
        span = 16
        while True:
            bits = np.unpackbits(self.high[first: first + span], bitorder="little")[skip:]
            ones = np.flatnonzero(bits)
            if len(ones) > left or first + span >= len(self.high):
                break
            span *= 4
        high = at + int(ones[left]) - i
        if not self.l:
            return high
        from_bit = i * self.l
        raw = int.from_bytes(self.low[from_bit // 8: (from_bit + self.l + 7) // 8].tobytes(), "little")
        return (high << self.l) | ((raw >> (from_bit % 8)) & ((1 << self.l) - 1))

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``, from 0: the unary bits are unpacked once, the low bits of those places only."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        high = ones[i] - i
        if not self.l:
            return high
        at = i[:, None] * self.l + np.arange(self.l)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (high << self.l) | (bits.astype(np.int64) << np.arange(self.l)).sum(axis=1)

    def values(self) -> np.ndarray:
        """All values."""
        return self.select_many(np.arange(self.n))


#: Runs of Latin-1 letters, and of anything else but white space, of a text in lower case.
_RUNS = re.compile("[a-z\u00AA\u00B5\u00BA\u00DF-\u00F6\u00F8-\u00FF]+|[^a-z\u00AA\u00B5\u00BA\u00DF-\u00F6\u00F8-\u00FF \n\t\r]+").findall
_LETTERS = re.compile("[a-z\u00AA\u00B5\u00BA\u00DF-\u00F6\u00F8-\u00FF]").match


class _Words:
    """Ids of parts of texts as bytes, remembered up to a bound; the library encodes what is new.

    Parts are white-space separated words; those of Latin-1 texts without
    apostrophes or special tokens are runs of letters and of other characters,
    of which fewer are new. This holds for vocabularies of the rules that
    :func:`_splits_on_space` asks for.
    """

    def __init__(self, spec: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_str(spec), "H" if width == 2 else "I"
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.known: dict[str, bytes] = {}
        self.held = 0
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for t, i in names.items() if t.endswith("</w>")]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def learn(self, fresh: list[str]) -> None:
        self.known.update(zip(fresh, self.ids(fresh)))

    def learn_letters(self, fresh: list[str]) -> None:
        """Encode runs of letters as one text; each ends with its only token that is marked as an end."""
        e = np.array(self.encode([" ".join(fresh)], add_special_tokens=False)[0].ids, np.int64)
        at = np.flatnonzero(self.ends[e]) + 1
        if len(at) != len(fresh):
            self.learn(fresh)
            return
        width = 2 if self.kind == "H" else 4
        data, bounds = e.astype(f"<u{width}").tobytes(), (at * width).tolist()
        self.known.update(zip(fresh, [data[i:j] for i, j in zip([0, *bounds[:-1]], bounds)]))

    def split(self, text: str) -> list[str]:
        if "'" not in text and "<|" not in text:
            try:
                text.encode("latin-1")
                return _RUNS(text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def of(self, texts: list[str], by_word: bool) -> list[bytes]:
        if not by_word:
            return self.ids(texts)
        if self.held > CACHE:
            self.known.clear()
            self.held = 0
        split = list(map(self.split, texts))
        fresh = set().union(*split).difference(self.known)
        letters = [w for w in fresh if _LETTERS(w) and w.isalpha() and w == w.lower()]
        for i in range(0, len(letters), 20_000):
            self.learn_letters(letters[i: i + 20_000])
        self.learn([w for w in fresh if w not in self.known])
        self.held += sum(map(len, fresh)) + ENTRY * len(fresh)
        return [b"".join(map(self.known.__getitem__, s)) for s in split]


_loaded: dict = {}


def _words(spec: str, width: int) -> _Words:
    key = (hashlib.sha1(spec.encode()).digest(), width)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = _Words(spec, width)
    return _loaded[key]


def _splits_on_space(spec: str) -> bool:
    """Whether a text's ids are those of its words one after the other, by the rules that the vocabulary file states; texts are encoded whole by any other file."""
    rules = json.loads(spec)
    split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = rules.get("model") or {}
    return (
        (rules.get("normalizer") or {}).get("normalizers") == NORMAL and steps[0] == split and all(
            s.get("type") == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:]
        )
        and model.get("type") == "BPE" and model.get(
            "end_of_word_suffix"
        ) == "</w>" and not model.get("dropout") and not model.get("unk_token") and rules.get("post_processor") is None
        and not any(" " in t["content"] or t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") for t in rules["added_tokens"]))


def _block(shard: int, number: int, first: int, width: int, parts: list[bytes], ids: list[int | None]) -> dict:
    ends = np.cumsum([len(p) // width for p in parts])
    known = np.array([0 if i is None else i for i in ids], "<i8")
    return {
        "shard": shard, "block": number, "first": first, "n_docs": len(parts), "n_ids": int(
            ends[-1]
        ), "width": width, "ids": b"".join(parts),
        "ends": EliasFano.encode(ends).to_bytes(), "doc_ids": zlib.compress(np.diff(known, prepend=0).astype("<i8").tobytes(), 1),
        "has_id": np.packbits([i is not None for i in ids]).tobytes(),
    }


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode ``docs`` (doc_id, text) with a ``tokenizers`` file and write a store at ``path``.

    Each text gets the ids of the library without special tokens, then
    ``end_id``; a null text counts as empty. Documents ascend by doc_id, null
    first; rows of one doc_id follow each other, and equal rows are each written.
    An empty table gives a store without blocks. Other columns are not read.
    The vocabulary file is read on the driver and sent to the tasks.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    tokenizer = Tokenizer.from_str(spec)
    width = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    by_word, end = _splits_on_space(spec), np.array([end_id], f"<u{width}").tobytes()
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    out = pa.schema(
        [
            ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
            ("width", pa.int32()), ("ids", pa.binary()), ("ends", pa.binary()), ("doc_ids", pa.binary()), ("has_id", pa.binary())
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(sent.value, width)
        shard, number, first, held, parts, ids = 0, 0, 0, 0, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256).to_pydict()
                for i, p, data in zip(some["doc_id"], some["shard"], words.of(some["text"], by_word)):
                    shard = p
                    parts.append(data + end)
                    ids.append(i)
                    held += len(data) + width
                    if held >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_pylist([_block(shard, number, first, width, parts, ids)], out)
                        number, first, held, parts, ids = number + 1, first + held // width, 0, [], []
        if parts:
            yield pa.RecordBatch.from_pylist([_block(shard, number, first, width, parts, ids)], out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.withColumn(
        "shard", F.spark_partition_id()
    ).mapInArrow(encode, SCHEMA).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def _documents(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, whether each is known, and the offsets in ids of each document's start and end."""
    index = EliasFano.from_bytes(block["ends"])
    ends = index.select_many(np.arange(block["n_docs"]))
    known = np.cumsum(np.frombuffer(zlib.decompress(block["doc_ids"]), "<i8"))
    has = np.unpackbits(np.frombuffer(block["has_id"], np.uint8), count=block["n_docs"]).astype(bool)
    return known, has, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)


def _read(spark: SparkSession, path: str, name: str, kind: str, arrow: pa.DataType, value: Callable[[bytes, int], object]) -> DataFrame:
    """(doc_id, start, n_tokens, name): ``value`` of each document's bytes and their width, block by block."""
    store = spark.read.schema(SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                known, has, starts, ends = _documents(r)
                w, ids = r["width"], memoryview(r["ids"])
                for i in range(0, r["n_docs"], 512):
                    part = slice(i, i + 512)
                    made = [value(ids[a * w: b * w], w) for a, b in zip(starts[part].tolist(), ends[part].tolist())]
                    n = len(made)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(known[part], mask=~has[part]), pa.array([r["shard"]] * n, pa.int32()),
                            pa.array(starts[part] + r["first"]), pa.array(ends[part] - starts[part]), pa.array(made, arrow)
                        ],
                        names=["doc_id", "shard", "inner", "n_tokens", name]
                    )

    docs = store.mapInArrow(decode, f"doc_id long, shard int, inner long, n_tokens long, {name} {kind}")
    shards = store.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select(
        F.col("shard"),
        F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    # a row for each task that wrote the store, so of a size to broadcast
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", name)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a store; start counts the ids of all documents before.

    A null doc_id comes back as null, repeated ones each with their own ids;
    an empty store gives no rows. A block's ids are in memory at once.
    """
    return _read(spark, path, "ids", "array<int>", pa.list_(pa.int32()), lambda data, w: np.frombuffer(data, f"<u{w}").astype(np.int32))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of a store: the crc of the ids as little-endian unsigned 32-bit integers.

    Nulls, repeated doc_ids and empty stores as in :func:`read_tokens`.
    """
    return _read(spark, path, "ids_crc32", "long", pa.int64(), lambda data, w: zlib.crc32(np.frombuffer(data, f"<u{w}").astype("<u4")))
