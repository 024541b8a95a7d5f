"""Mixing sources to target weights: hash-random order, prefix sums of sizes, exact budgets, epochs.

Within a source documents stand in a random order given by a hash of their
id. A source of budget B and total size S is taken ``floor(B / S)`` times
whole, and once more up to the point where the prefix sum of sizes comes
nearest to the rest of the budget: documents are taken whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herald.llm._common import materialize, n_words
from herald.llm._scan import prefix_sums


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: the source's part of ``share`` of all sizes.

    Sources ascending by code point, null last, get the weights in turn. No
    target goes above ``most`` times its source's size; what is over is shared
    by weight among the others, until none is above. That is the level L at
    which ``sum(min(most * size, L * weight))`` meets the total: in ascending
    order of ``most * size / weight`` the sources below L are a prefix, so
    prefix sums find it.
    """
    ranked = prefix_sums(
        materialize(sizes.withColumns({"one": F.lit(1).cast("long"), "last": F.isnull("source")})), [], [F.col("last"), F.col("source")],
        {"one": "rank"}
    )
    table = F.array(*[F.lit(float(w)) for w in weights])
    turn = (F.col("rank") % len(weights)).cast("int")
    w = ranked.select(
        "source", "source_size", F.element_at(table, turn + 1).alias("weight"),
        *[(turn == i).cast("long").alias(f"is_{i}") for i in range(len(weights))]
    )
    w = w.withColumn("fill", most * F.col("source_size") / F.col("weight"))
    total = w.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w"), F.count("*").alias("n")).first()
    if not total["s"]:
        return w.select("source", "source_size", F.lit(0.0).alias("target"))
    budget = min(share, most) * float(total["s"])
    # sums over the sources that fill up before each one, smallest ratio first
    order = [F.col("fill"), F.isnull("source"), F.col("source")]
    below = prefix_sums(w, [], order, {"source_size": "before", **{f"is_{i}": f"n_{i}" for i in range(len(weights))}})
    used = reduce(add, [F.lit(float(x)) * F.col(f"n_{i}") for i, x in enumerate(weights)])
    below = below.withColumns({"full": F.lit(most) * F.col("before"), "used": used})
    level = (F.lit(budget) - F.col("full")) / (F.lit(float(total["w"])) - F.col("used"))
    open_ = below.withColumn("level", level).filter(F.col("fill") > F.col("level")).agg(
        F.min(F.struct("fill", "level")).alias("x")
    ).first()["x"]
    reached = open_["level"] if open_ else float("inf")
    return w.select("source", "source_size", F.least(F.lit(most) * F.col("source_size"), F.lit(reached) * F.col("weight")).alias("target"))


def _planned(rows: DataFrame, weights: Sequence[float], share: float, most: float, late: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` (__source, __draw, __key, __size, others) with __total, __target and __copies."""
    placed = prefix_sums(rows, ["__source"], [F.col("__draw"), F.col("__key")], {"__size": "__before"}, late)
    sizes = placed.groupBy("__source").agg(F.sum("__size").alias("source_size")).withColumnRenamed("__source", "source")
    goal = targets(sizes, weights, share, most).select(
        F.col("source").alias("__s"), F.col("source_size").alias("__total"), F.col("target").alias("__target")
    )
    joined = placed.join(goal, F.col("__source").eqNullSafe(F.col("__s")))
    rounds = F.when(F.col("__total") > 0, F.floor(F.col("__target") / F.col("__total"))).otherwise(F.lit(0))
    rest = F.col("__target") - rounds * F.col("__total")
    fits = (F.col("__before") + F.col("__size") / 2 <= rest) & (rest > 0)
    return joined.withColumn("__copies", F.least((rounds + F.when(fits, 1).otherwise(0)).cast("long"), F.lit(int(most))))


def _size(size: Column | None) -> Column:
    return (n_words(F.col("text")) if size is None else size).cast("long")


def _keys(seed: int) -> list[Column]:
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))))
    return [F.col("source").cast("string").alias("__source"), F.xxhash64("text").alias("__key"), draw.alias("__draw")]


def mix(
    docs: DataFrame, size: Column | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7
) -> DataFrame:
    """One row (doc_id, source, text_key, size, source_size, target, copies, taken) for each row of ``docs``.

    ``copies`` says how often the mix takes the document, ``taken`` how many
    words that is. A null text has size 0 and, like any empty one, is taken
    with the documents beside it, which costs nothing. A null source is a
    source of its own, last. Rows that tie in doc_id are ordered by a hash of
    their text; equal rows are each counted. An empty table gives an empty
    result. Other columns are not read, and texts only once.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(seed), _size(size).alias("__size")))
    out = {
        "__source": "source", "__key": "text_key", "__size": "size", "__total": "source_size", "__target": "target", "__copies": "copies"
    }
    return _planned(rows, weights, share, most).select(
        "doc_id", *[F.col(c).alias(n) for c, n in out.items()], (F.col("__size") * F.col("__copies")).alias("taken")
    )


def take(
    docs: DataFrame, size: Column | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` says, all columns kept.

    Nulls, ties and empty tables are treated as there. Each of equal rows is
    planned by its own place in the order, so together they are taken as
    often as planned, and no source passes its target by more than half a
    document. Whole rows go through the range sort, once.
    """
    rows = docs.select(*[docs[c] for c in docs.columns], *_keys(seed))
    planned = _planned(rows, weights, share, most, {"__size": _size(size)}).filter("__copies > 0")
    return planned.withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('7:' || doc_id) AS draw, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
f AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS fill,
         coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS full_, coalesce(sum(weight) OVER o, 0) AS used,
         (SELECT sum(source_size) FROM s)::DOUBLE AS total, (SELECT sum(weight) FROM w) AS all_w
  FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min(level) AS level FROM (
  SELECT (1.5 * total - full_) / (all_w - used) AS level FROM f WHERE fill > (1.5 * total - full_) / (all_w - used) ORDER BY fill LIMIT 1)),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT level FROM l) * weight) AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS rounds
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * least(2, rounds + CASE WHEN target - rounds * source_size > 0 AND before_ + size / 2.0 <= target - rounds * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
