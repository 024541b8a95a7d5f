"""Exact nearest vectors by dot product, without reading groups of vectors that cannot matter.

Centres are fitted on a bounded sample; every vector is written with the group
of its nearest centre. A group knows its size, the range of its members' lengths
along the centre's direction ``u``, and the greatest length across it. For a
query ``q`` and a member ``x``, ``q.x = (q.u)(x.u) + q'.x'`` with the parts
across ``u``, and ``|q'.x'|`` is ``|q'||x'|`` at most by the inequality of
Cauchy and Schwarz. A search reads each query's best groups for a
floor under its k-th score, and then only groups whose bound reaches the floor.
The place of a vector in the full list is counted alike: groups wholly above or
below its score are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herald.operators.impact_index import top
from herald.sources.scratch import new_path, written

#: Vectors that centres are fitted on at most, centres at most, and rounds of fitting.
SAMPLE, CENTRES, ROUNDS = 10_000, 1024, 4
#: Queries that are searched together, vectors of a part of a large group about, and parts of it at most.
QUERIES, PART, PARTS = 4096, 16_384, 8
#: Scores that a task works out at once, and found ones that it keeps before it drops those below a k-th.
SCORES, FOUND = 4_000_000, 2_000_000
#: Digits of a score, and what bounds allow for its rounding.
DIGITS, SLACK = 9, 1e-8


@dataclass
class Index:
    """``rows`` (vec, vector, group) by group in the shared folder; of each group its direction, least and greatest length along it,
    greatest length across it, and size."""

    rows: DataFrame
    along: np.ndarray
    low: np.ndarray
    high: np.ndarray
    across: np.ndarray
    size: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def build(vectors: DataFrame, vector_id: str = "vec_id", centres: int | None = None) -> Index:
    """Index of ``vectors`` (vector_id, embedding); null vectors are left out, all others have one length.

    The sample is the ``SAMPLE`` vectors of least hash of their id; every
    vector is indexed. Without vectors the index is empty.
    """
    spark = vectors.sparkSession
    known = vectors.filter("embedding is not null").select(F.col(vector_id).cast("long").alias("vec"), "embedding")
    sample = known.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE)
    x = np.array([r["embedding"] for r in sample.collect()], np.float64)
    every = known.count()
    n = centres or min(CENTRES, max(1, int(np.sqrt(every))))
    parts = min(PARTS, max(1, every // (n * PART)))  # small groups have one file each: searches open them all
    c = x[:n]
    for _ in range(ROUNDS if len(x) else 0):
        group = _nearest(x, c)
        sums, counts = np.zeros_like(c), np.bincount(group, minlength=len(c))
        np.add.at(sums, group, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)

    norm = np.linalg.norm(c, axis=1, keepdims=True) if len(c) else np.ones((0, 1))
    u = c / np.where(norm > 0, norm, 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("embedding"))
            group = _nearest(m, c)
            along = (m * u[group]).sum(axis=1)
            across = np.linalg.norm(m - along[:, None] * u[group], axis=1)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), m.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec"), vector, *map(pa.array, (group.astype(np.int32), along, across))],
                names=["vec", "vector", "group", "along", "across"])

    schema = "vec long, vector array<double>, group int, along double, across double"
    path = new_path(spark, "vectors")
    rows = known.mapInArrow(assign, schema) if len(x) else spark.createDataFrame([], schema)
    rows.repartition("group", F.pmod(F.xxhash64("vec"), F.lit(parts))).write.partitionBy("group").parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    low, high, across, size = (np.zeros(len(c)) for _ in range(4))
    sums = rows.groupBy("group").agg(F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("across"), F.count("*").alias("n"))
    for r in sums.collect():
        low[r["group"]], high[r["group"]], across[r["group"]], size[r["group"]] = r["low"], r["high"], r["across"], r["n"]
    return Index(rows.select("vec", "vector", "group"), u, low, high, across, size.astype(np.int64))


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a stated set of queries, a block at a time; null vectors are left out."""
    rows = queries.filter("vector is not null").select("query_id", "vector").orderBy("query_id").toLocalIterator()
    while some := list(islice(rows, QUERIES)):
        yield np.array([r["query_id"] for r in some], np.int64), np.array([r["vector"] for r in some], np.float64)


def _read(index: Index, wanted: np.ndarray, q: np.ndarray, run: Callable, done: Callable, schema: str) -> DataFrame:
    """``run(kept, vecs, scores, queries, group)`` of the groups that a query wants, ``wanted`` having a row for each query: the plain scores
    of some of those queries (rows) and a part of the group. What it returns the task keeps for the next; ``done`` of the last are its rows."""
    groups = np.flatnonzero(wanted.any(axis=0))
    of = {int(g): np.flatnonzero(wanted[:, g]) for g in groups}
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for batch in batches:
            group = batch.column("group").to_numpy(zero_copy_only=False)
            for g in np.unique(group):
                part = batch.filter(pa.array(group == g))
                vecs, x, own = part.column("vec").to_numpy(), _matrix(part.column("vector")).T, of[int(g)]
                step = max(1, SCORES // len(vecs))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    kept = run(kept, vecs, q[some] @ x, some, int(g))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in done(kept)], names=names)

    return index.rows.filter(F.col("group").isin([int(g) for g in groups])).mapInArrow(each, schema)


def bounds(index: Index, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of each query and group."""
    on = q @ index.along.T
    beside = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] - on * on, 0)) * index.across + SLACK
    ends = on * index.low, on * index.high
    return np.minimum(*ends) - beside, np.maximum(*ends) + beside


def search(index: Index, queries: DataFrame, k: int, vector_id: str = "vec_id", read: list | None = None) -> DataFrame:
    """(query_id, vector_id, score, rank): the ``k`` nearest vectors by dot product of each query; equal scores by id.

    ``read`` gets (vectors compared, all pairs) for each block of queries.
    """
    schema = f"query_id long, {vector_id} long, score double"
    out = None
    for ids, q in _blocks(queries) if len(index.along) else ():
        floor = np.full(len(ids), -np.inf)
        _, upper = bounds(index, q)
        upper = np.where(index.size > 0, upper, -np.inf)
        order = np.argsort(-upper, axis=1, kind="stable")
        enough = np.cumsum(index.size[order], axis=1) - index.size[order] < k  # the first groups that hold k vectors
        first = np.zeros_like(enough)
        np.put_along_axis(first, order, enough, axis=1)
        first &= index.size > 0
        found = top(_best(index, first, ids, q, floor, k, schema), k, vector_id)
        rest = ~first & (index.size > 0)
        if rest.any():
            found = written(found, "first")
            place = {int(i): n for n, i in enumerate(ids)}
            for r in found.filter(F.col("rank") == k).select("query_id", "score").collect():
                floor[place[r["query_id"]]] = r["score"]
            rest &= upper >= floor[:, None]
        if read is not None:
            read.append((int(((first | rest) * index.size).sum()), len(ids) * int(index.size.sum())))
        part = found.drop("rank")
        if rest.any():
            part = part.unionByName(_best(index, rest, ids, q, floor, k, schema))
        out = part if out is None else out.unionByName(part)
    return top(queries.sparkSession.createDataFrame([], schema) if out is None else out, k, vector_id)


def _best(index: Index, wanted: np.ndarray, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, schema: str) -> DataFrame:
    """The ``k`` best of the wanted groups that each task reads, from ``floor`` on; a query's k-th so far raises its floor in the task."""

    def first(parts: list) -> tuple:
        """(queries, vectors, scores): the ``k`` best of each query, by query."""
        row, vec, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((vec, -score, row))
        row = row[order]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        within = np.arange(len(row)) - np.repeat(start, np.diff(start, append=len(row)))
        return row[within < k], vec[order][within < k], score[order][within < k]

    def run(kept: list, vecs: np.ndarray, s: np.ndarray, own: np.ndarray, group: int) -> list:
        # kept: the least score of each query that may still matter, how many are pending, and the parts found
        least, pending, parts = kept or (floor.copy(), 0, [])
        at = least[own]
        if s.shape[1] > k and np.isneginf(at).any():
            at = np.maximum(at, np.round(-np.partition(-s, k - 1, axis=1)[:, k - 1], DIGITS))
        row, column = np.nonzero(s >= (at - SLACK)[:, None])
        score = np.round(s[row, column], DIGITS)
        good = score >= at[row]
        parts.append((own[row[good]], vecs[column[good]], score[good]))
        pending += int(good.sum())
        if pending > FOUND:
            parts = [first(parts)]
            row, _, score = parts[0]
            last = np.flatnonzero(np.diff(row, append=-1))
            full = np.bincount(row, minlength=len(least))[row[last]] == k
            least[row[last][full]] = np.maximum(least[row[last][full]], score[last][full])
            pending = 0
        return [least, pending, parts]

    def done(kept: list) -> tuple:
        row, vec, score = first(kept[2]) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return ids[row], vec, score

    return _read(index, wanted, q, run, done, schema)


def places(index: Index, queries: DataFrame, pairs: DataFrame, vector_id: str = "vec_id") -> DataFrame:
    """``pairs`` (query_id, vector_id) with ``rank``: the vector's place in the query's list of all vectors.

    Pairs of a null or unknown vector have no row. ``pairs`` are few for each
    query; their scores are read first, then counted below.
    """
    out, spark = None, queries.sparkSession
    schema = f"query_id long, {vector_id} long, before long"
    for ids, q in _blocks(queries) if len(index.along) else ():
        place = {int(i): n for n, i in enumerate(ids)}
        own = pairs.join(spark.createDataFrame([(int(i),) for i in ids], "query_id long"), "query_id").select(
            "query_id", F.col(vector_id).alias("vec"))
        scored = [
            (place[r["query_id"]], r["vec"], float(np.round(q[place[r["query_id"]]] @ np.array(r["vector"]), DIGITS)))
            for r in own.join(index.rows, "vec").select("query_id", "vec", "vector").collect()]
        if not scored:
            continue
        lower, upper = bounds(index, q)
        of, vec, mine = (np.array(c) for c in zip(*sorted(scored)))
        wanted, above = np.zeros(lower.shape, bool), []
        for i, v, x in zip(of.tolist(), vec.tolist(), mine.tolist()):
            over = lower[i] > x
            above.append((int(ids[i]), v, int(index.size[over].sum())))
            wanted[i] |= ~over & (upper[i] >= x) & (index.size > 0)
        part = _before(index, wanted, lower, ids, q, (of, vec, mine), schema)
        part = spark.createDataFrame(above, schema).unionByName(part)
        part = part.groupBy("query_id", vector_id).agg((F.sum("before") + 1).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"query_id long, {vector_id} long, rank long") if out is None else out


def _before(index: Index, wanted: np.ndarray, lower: np.ndarray, ids: np.ndarray, q: np.ndarray, pairs: tuple, schema: str) -> DataFrame:
    """How many vectors of the wanted groups stand before the vectors of ``pairs`` (queries in order, vectors, scores), task by task."""
    of, vec, mine = pairs

    def run(kept: list, vecs: np.ndarray, s: np.ndarray, own: np.ndarray, group: int) -> list:
        before = kept or [np.zeros(len(of), np.int64)]
        at = np.flatnonzero(np.isin(of, own) & (lower[of, group] <= mine))
        step = max(1, SCORES // len(vecs))
        for some in (at[i : i + step] for i in range(0, len(at), step)):
            x = s[np.searchsorted(own, of[some])] - mine[some][:, None]
            before[0][some] += (x > SLACK).sum(axis=1)
            row, column = np.nonzero(np.abs(x) <= SLACK)  # so near that the rounding of both counts
            pair, other = some[row], vecs[column]
            score = np.round(s[np.searchsorted(own, of[pair]), column], DIGITS)
            ahead = (other != vec[pair]) & ((score > mine[pair]) | ((score == mine[pair]) & (other < vec[pair])))
            np.add.at(before[0], pair[ahead], 1)
        return before

    def done(kept: list) -> tuple:
        met = np.flatnonzero(kept[0]) if kept else np.zeros(0, np.int64)
        return ids[of[met]], vec[met], kept[0][met] if kept else met

    return _read(index, wanted, q, run, done, schema)
