"""Reciprocal rank fusion over the current documents by the ranks among all, without full lists.

Each ranking gives the first ``d`` of its list. A document outside of both
scores ``2 / (61 + d)`` at most, and one that stands in one list only has a
bound of its own. Documents whose bound is below the k-th best sure score are
out; the places of the others in the list that lacks them are counted, not
listed. If the k-th best exact score is above the bound of all unseen documents
the query is done; the others go on with a larger ``d``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herald.operators import impact_index, metric_index
from herald.operators.retrieval import collapse_identity
from herald.sources.scratch import written

#: Rank constant of reciprocal rank fusion (a fixed value).
RRF_K = 60
#: First depth of the lists, that for each document asked for if these are few, and how much deeper each further round goes.
DEPTH, EACH, DEEPER = 128, 16, 4
#: What may stand between sums of the same ranks.
_EPS = 1e-11


@dataclass
class Ranking:
    """A total order of documents for each query.

    ``best(queries, d)``: (query_id, doc, rank) of the first ``d``;
    ``places(queries, pairs)``: the pairs (query_id, doc) with their rank in
    the whole list, those outside of it left out.
    """

    best: Callable[[DataFrame, int], DataFrame]
    places: Callable[[DataFrame, DataFrame], DataFrame]


def lexical(index: impact_index.Index) -> Ranking:
    """BM25Plus over all documents, those without a term of the query last; for queries with ``text``."""
    return Ranking(
        lambda q, d: impact_index.search(index, q, d, "doc").drop("score"), lambda q, p: impact_index.places(index, q, p, "doc"))


def dense(index: metric_index.Index) -> Ranking:
    """Nearest vectors, for queries with ``vector``; documents have the id of their vector."""
    return Ranking(
        lambda q, d: metric_index.search(index, q, d, "doc").drop("score"), lambda q, p: metric_index.places(index, q, p, "doc"))


def _sum(ranks: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(1.0 / (RRF_K + r), F.lit(0.0)) for r in ranks])


def fuse_current(
    rankings: Sequence[Ranking], queries: DataFrame, current: DataFrame, k: int, size: int, depth: int = DEPTH, rounds: list | None = None
) -> DataFrame:
    """(query_id, doc, score, rank): the ``k`` best of ``current`` (doc) by fused ranks among all ``size`` documents.

    Ties go to what stands first in the earliest list. Queries have distinct
    ids; one that no ranking knows has no row. What is gathered for a query is
    ``d`` rows a ranking, in each round for the queries that are still open.
    ``rounds`` gets (depth, open queries) of each.
    """
    spark, out, open_, d = queries.sparkSession, [], queries, depth
    names = [f"r{i}" for i in range(len(rankings))]
    now = current.select("doc").distinct()
    while True:
        if rounds is not None:
            rounds.append((d, open_.count()))
        lists = [r.best(open_, d).select("query_id", "doc", F.lit(i).alias("list"), "rank") for i, r in enumerate(rankings)]
        listed = written(reduce(DataFrame.unionByName, lists), "lists")
        open_ = open_.join(listed.select("query_id").distinct(), "query_id", "left_semi")  # the others have no list
        seen = listed.groupBy("query_id", "doc").agg(
            *[F.max(F.when(F.col("list") == i, F.col("rank"))).alias(n) for i, n in enumerate(names)]).join(now, "doc", "left_semi")
        upper = _sum([F.coalesce(n, F.lit(d + 1)) for n in names])
        by_sure = Window.partitionBy("query_id").orderBy(F.col("sure").desc())
        bounded = seen.withColumns({"sure": _sum([F.col(n) for n in names]), "upper": upper})
        bounded = bounded.withColumn("n", F.row_number().over(by_sure))
        kth = F.max(F.when(F.col("n") == k, F.col("sure"))).over(Window.partitionBy("query_id"))
        able = bounded.withColumn("kth", F.coalesce(kth, F.lit(0.0))).filter(F.col("upper") >= F.col("kth") - _EPS)
        able = written(able.select("query_id", "doc", *names), "able")
        exact = able
        for n, r in zip(names, rankings):
            missing = able.filter(F.isnull(n)).select("query_id", "doc")
            asked = open_.join(missing.select("query_id").distinct(), "query_id", "left_semi")
            found = r.places(asked, missing).select("query_id", "doc", F.col("rank").alias("place"))
            exact = exact.join(found, ["query_id", "doc"], "left").withColumn(n, F.coalesce(n, "place")).drop("place")
        first = F.coalesce(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(i).alias("list"), F.col(n).alias("rank"))) for i, n in enumerate(names)])
        order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first", "doc")
        fused = exact.withColumns({"score": _sum([F.col(n) for n in names]), "first": first})
        fused = written(fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "fused")
        out.append(fused.select("query_id", "doc", "score", "rank"))
        if d >= size:
            break
        done = fused.filter((F.col("rank") == k) & (F.col("score") > len(rankings) / (RRF_K + 1.0 + d) + _EPS)).select("query_id")
        open_ = written(open_.join(done, "query_id", "left_anti"), "open")
        out[-1] = out[-1].join(done, "query_id", "left_semi")
        if open_.isEmpty():
            break
        d = min(size, d * DEEPER)
    return reduce(DataFrame.unionByName, out)


def current_evidence(
    rankings: Sequence[Ranking], queries: DataFrame, chunks: DataFrame, size: int, k: int = 10, rounds: list | None = None
) -> DataFrame:
    """(query_id, notice_id, version_id, rank): the identities that a search of current versions lists, best first.

    The rankings are fused over the chunks of latest versions, the ``k`` best
    are kept, and the first of each identity counts. ``chunks``: chunk_id,
    notice_id, version_id, is_latest; ``size`` of them are ranked.
    """
    named = chunks.select(F.col("chunk_id").alias("doc"), "notice_id", "version_id")
    now = chunks.filter("is_latest").select(F.col("chunk_id").alias("doc"))
    # any depth leads to the same result; short lists settle the queries whose best stands first in all of them
    fused = fuse_current(rankings, queries, now, k, size, min(DEPTH, EACH * k), rounds)
    return collapse_identity(fused.join(named, "doc"), ["notice_id", "version_id"]).select("query_id", "notice_id", "version_id", "rank")
