"""Document fingerprints: weighted SimHash, and a search by permuted block tables.

The terms of a text are its words and pairs of adjacent words, each as often
as it occurs; short texts also have runs of four characters, whose weight
falls to nothing at 64 words, so that a few words changed do not decide all.
Each term's hash votes with the term's weight for or against every bit. The
share of differing bits of two fingerprints estimates the angle between the
weighted term vectors (Charikar, 2002); ``likeness`` is its cosine, from 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herald.llm._common import materialize, text_of
from herald.llm._shingles import mix

BITS = 128
#: Below so many words, character runs count too.
SHORT = 64
_CHUNK = 1 << 14
_STEPS = np.arange(1, 1 + BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _votes(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, np.float64)
    for i in range(0, len(terms), _CHUNK):
        lanes = np.stack([mix(terms[i: i + _CHUNK] + _STEPS[k]) for k in range(BITS // 64)], axis=1)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1)
        w = weights[i: i + _CHUNK].astype(np.float32)
        total += 2.0 * (w @ bits.astype(np.float32)).astype(np.float64) - float(w.sum())
    return total


def simhash(text: str) -> bytes:
    """The fingerprint of a text; that of a text without words is all zero bits."""
    words = text.split()
    if not words:
        return bytes(BITS // 8)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    pairs = mix(h[:-1] * np.uint64(3) + mix(h[1:]))
    parts, weights = [h, pairs], [np.full(len(h), 0.5), np.ones(len(pairs))]
    if len(words) < SHORT:
        joined = f" {' '.join(words)} "
        runs = [joined[i: i + 4] for i in range(max(1, len(joined) - 3))]
        parts.append(np.fromiter(map(_hashes.__getitem__, runs), np.uint64, len(runs)))
        weights.append(np.full(len(runs), 1.0 - len(words) / SHORT))
    return np.packbits(_votes(np.concatenate(parts), np.concatenate(weights)) > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: the cosine that the differing bits stand for, 0 from a right angle on; 1 for equal fingerprints."""
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return 1.0 if not differ else max(0.0, float(np.cos(np.pi * differ / (8 * len(a)))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint hex) of each row of ``docs`` (doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t.as_py()).hex() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")
    ).mapInArrow(run, "doc_id long, fingerprint string")


def within_radius(prints: DataFrame, radius: int = 3, hot: int = 64) -> DataFrame:
    """Links (a, b, distance) between different fingerprints within ``radius`` bits, and none else.

    Permuted block tables: the hex digits are cut into ``radius + 1`` blocks,
    with a table keyed by each: fingerprints that differ in at most ``radius``
    bits agree in some block. Where more than ``hot`` fingerprints share a
    block, their other digits are cut into ``2 * radius`` parts and keyed by
    each choice of ``radius`` of these, of which two such fingerprints agree in
    one too; so only fingerprints that agree in most digits meet. Documents of
    one fingerprint are one row: a and b are fingerprints, a < b. Rows of
    ``prints`` (fingerprint, others) without one are left out; an empty table
    has no links.
    """
    digits = BITS // 4
    edge = [round(i * digits / (radius + 1)) for i in range(radius + 2)]
    one = prints.select("fingerprint").filter("fingerprint is not null").distinct()
    block = [F.substring("fingerprint", i + 1, j - i) for i, j in zip(edge, edge[1:])]
    table = one.select("fingerprint", F.posexplode(F.array(*[F.xxhash64(F.lit(n), b) for n, b in enumerate(block)])).alias("block", "key"))
    shared = table.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    table = materialize(table.join(shared, "key"))
    fine = table.filter(F.col("n") > hot).withColumn("part", F.explode(_fine_keys(edge, digits, radius)))
    fine = fine.select("fingerprint", F.xxhash64("key", "part").alias("key"))
    again = materialize(fine.join(fine.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key", "left_semi"))
    return _met(table.filter(F.col("n") <= hot), radius).unionByName(_met(again, radius)).distinct()


def _fine_keys(edge: list[int], digits: int, radius: int) -> Column:
    """For the block a row met in: a key for each choice of ``radius`` parts of its other digits."""
    by_block = []
    for i, j in zip(edge, edge[1:]):
        left = F.concat(F.substring("fingerprint", 1, i), F.substring("fingerprint", j + 1, digits - j))
        cut = [round(k * (digits - j + i) / (2 * radius)) for k in range(2 * radius + 1)]
        parts = [F.substring(left, x + 1, y - x) for x, y in zip(cut, cut[1:])]
        by_block.append(
            F.array(
                *[F.xxhash64(F.lit(n), *[parts[k] for k in chosen]) for n, chosen in enumerate(combinations(range(2 * radius), radius))]
            )
        )
    out = by_block[-1]
    for n, keys in reversed(list(enumerate(by_block[:-1]))):
        out = F.when(F.col("block") == n, keys).otherwise(out)
    return out


def _met(table: DataFrame, radius: int) -> DataFrame:
    """Pairs of rows (key, fingerprint) of one key that lie within the radius."""
    lanes = F.array(*[F.conv(F.substring("fingerprint", i + 1, 8), 16, 10).cast("long") for i in range(0, BITS // 4, 8)])
    rows = table.select("key", "fingerprint", lanes.alias("lanes"))
    a, b = (rows.select("key", F.col("fingerprint").alias(x), F.col("lanes").alias(f"{x}_lanes")) for x in "ab")
    distance = F.expr("aggregate(zip_with(a_lanes, b_lanes, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")
    return a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (distance <= radius)).select("a", "b", distance.alias("distance"))


_OUT = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_NAMES = ["kind", "part", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"]


def edit(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by as many first ones of ``following``, or all it has."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut] if cut else text


def _compare(doc_id: int | None, text: str, own: bytes, following: str, next_print: bytes) -> list:
    changed = edit(text, following)
    print_ = simhash(changed)
    return [
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(), print_.hex(),
        likeness(own, print_), likeness(own, next_print)
    ]


def neighbour_likeness(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and the likenesses.

    The edited text is :func:`edit` with the next document by doc_id; after
    the last comes the first, and a single document follows itself. Null texts
    count as empty, null doc_ids come first; rows of one doc_id follow each
    other by a hash of their text. An empty table gives an empty result. Other
    columns are not read.

    Rows are range-sorted once and compared while they stream past, so a task
    holds two texts. The first and last row of each partition, which miss a
    neighbour, are finished by a join with the next partition's first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for doc_id, part, text in zip(
                    some.column("doc_id").to_pylist(), some.column("part").to_pylist(), some.column("text").to_pylist()
                ):
                    own = simhash(text)
                    if held is None:
                        out.append([1, part, doc_id, None, None, own.hex(), None, None, None, text])
                    else:
                        out.append([0, part, *_compare(*held, text, own), None])
                    held = (doc_id, text, own)
                    last = part
                yield _batch(out)
                out = []
        if held is not None:
            yield _batch([[2, last, held[0], None, None, held[2].hex(), None, None, None, held[1]]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).withColumn(
        "part", F.spark_partition_id()
    )
    found = materialize(dealt.mapInArrow(run, _OUT))
    first = found.filter("kind = 1").select(
        F.col("part").alias("p"), F.col("text").alias("following"), F.col("fingerprint").alias("next_print")
    )
    # a row for each partition that has rows
    w = Window.orderBy("part")
    order = found.filter("kind = 1").select("part").withColumns(
        {"n": F.lead("part").over(w), "f": F.min("part").over(Window.partitionBy())}
    )
    ends = found.filter("kind = 2").select("part", "doc_id", "text", "fingerprint").join(order, "part")
    ends = ends.withColumn("p", F.coalesce("n", "f")).join(first, "p").select("doc_id", "text", "fingerprint", "following", "next_print")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch(
                [
                    [
                        0, 0,
                        *_compare(r["doc_id"], r["text"], bytes.fromhex(r["fingerprint"]), r["following"], bytes.fromhex(r["next_print"])),
                        None
                    ] for r in batch.to_pylist()
                ]
            )

    columns = _NAMES[2:9]
    return found.filter("kind = 0").select(*columns).unionByName(ends.mapInArrow(finish, _OUT).select(*columns))


def with_neighbours(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``prints`` (fingerprint, others) with ``n_close``: the number of other fingerprints in the table within ``radius`` bits.

    Fingerprints count once, however many rows have them; null ones have null.
    """
    links = materialize(within_radius(prints, radius))
    count = links.select(F.col("a").alias("__f")).unionByName(
        links.select(F.col("b").alias("__f"))
    ).groupBy("__f").agg(F.count("*").alias("__n"))
    joined = prints.join(count, F.col("fingerprint") == F.col("__f"), "left")
    return joined.select(
        *[prints[c] for c in prints.columns],
        F.when(F.col("fingerprint").isNotNull(), F.coalesce("__n", F.lit(0)).cast("long")).alias("n_close")
    )


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=_NAMES)
