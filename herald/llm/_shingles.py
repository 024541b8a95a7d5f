"""Hashed word shingles of Arrow batches, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herald.llm._common import materialize

#: Words of all documents that are worked on at once; a longer document is worked on alone.
BLOCK = 400_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _B
    x = x ^ (x >> np.uint64(27))
    x = x * _C
    return x ^ (x >> np.uint64(31))


def lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and, of each row, the length; null counts as empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = np.asarray(col.offsets).astype(np.int64)
    if col.null_count:
        col = col.fill_null([])
        off = np.asarray(col.offsets).astype(np.int64)
    values = col.values.to_numpy(zero_copy_only=False)[off[0]: off[-1]]
    return values, np.diff(off)


def blocks(lengths: np.ndarray, row: int = 0, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` list values, where a row counts as ``row`` values besides its own."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n + row > most:
            yield start, i
            start, held = i, 0
        held += int(n) + row
    if start < len(lengths):
        yield start, len(lengths)


def shingles(words: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hash of each window of ``k`` words; one window of all words where there are fewer."""
    total = len(words)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    pos, n = np.arange(total) - starts, np.repeat(lengths, lengths)
    take = np.flatnonzero((pos <= n - k) | ((pos == 0) & (n < k)))
    padded = np.concatenate([words.view(np.uint64), np.zeros(k, np.uint64)])
    h = np.zeros(len(take), np.uint64)
    for i in range(k):
        w = np.where(pos[take] + i < n[take], padded[take + i], np.uint64(i))
        h = mix(h * _A + w + np.uint64(i))
    doc = np.repeat(np.arange(len(lengths)), lengths)[take]
    return doc, h


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) in that order, and how often each occurs."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
    return doc[first], h[first], np.diff(np.concatenate([first, [len(h)]]))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the least node; single nodes are absent.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    is a minimum by key and a join. Edges of each round are written to the
    shared folder; it ends when each component is a star. Loops, repeated edges and an empty table are allowed.
    """
    e = edges.filter("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    while not _stars(e):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        e = materialize(
            joined.filter("b != m").select(
                F.col("b").alias("a"), F.col("m").alias("b")
            ).union(low.select("a", F.col("m").alias("b"))).distinct()
        )
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(e: DataFrame) -> bool:
    """Whether each component of the edges a > b is a star round its least node: no node has two lower ones, or one and a higher one."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").isEmpty()
