"""Ranked lexical search: documents grouped by the mask of an item's terms that they hold.

Documents become lists of (term, occurrences) of the items' terms only, which
are written once; counts over them give the weights. A task reads such lists in
blocks and works out each posting's part of a score once for all items. For
each item it sets a bit of each document for each matched term, groups the
documents by mask, and bounds each mask by the greatest parts its terms have in
the block. Masks are evaluated by descending bound until the bound is below the
tenth score found so far, in this block or an earlier one of the task, so what
is left cannot enter the result. Tasks send the best of each item, which are
merged in two steps; no task gets all documents of an item.

Items are a stated query set, taken in blocks of about ``TERMS`` terms; each
block costs a scan of the documents, and what is sent to tasks is bounded by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herald.llm._common import materialize
from herald.llm.resample import LOWER

#: Terms of the items that are searched together.
TERMS = 200_000
#: Postings of a block at most, but for a single document.
BLOCK = 2_000_000
#: A term, in bytes, after lower-casing A-Z: digits, letters and all that is not ASCII.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same as an expression on text.
_TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _item_terms(items: DataFrame) -> DataFrame:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), upper, lower), F.lit(_TERM_SQL), F.lit(0)))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row with a term: number of its terms, and those of the vocabulary with their occurrences.

    Null texts have no terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, terms, tfs = np.zeros(batch.num_rows, np.int64), [0], [], []
            for i, text in enumerate(x.as_py() for x in batch.column(1)):
                counts = Counter(m[0] for m in _TERM.finditer((text or "").encode("utf-8", "surrogatepass").translate(LOWER)))
                n[i] = counts.total()
                for word, tf in counts.items():
                    if (term := vocabulary.get(word)) is not None:
                        terms.append(term)
                        tfs.append(tf)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (terms, tfs)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, terms array<long>, tfs array<long>")


class _Best:
    """The k best documents of an item, by score and id."""

    def __init__(self, k: int):
        self.k, self.scores, self.docs = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        """Least score that may still enter."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        best = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[best], docs[best]


class Block:
    """Postings of some documents: ``ends`` of their lists, terms, and the part of a score of each posting."""

    def __init__(self, docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, terms: np.ndarray, parts: np.ndarray, n_terms: int):
        self.docs, self.starts, self.ends, self.terms, self.parts = docs, starts, ends, terms, parts
        by = np.argsort(terms, kind="stable")
        self.holders = np.repeat(np.arange(len(docs)), ends - starts)[by]
        self.bounds = np.searchsorted(terms[by], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, terms, parts)
        self.wanted = np.zeros(n_terms, bool)

    def masks(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(masks, group of each matching document, the documents): a row of bits, in 64-bit words, for each distinct mask."""
        bits = np.zeros((len(self.docs), (len(item) + 63) // 64), np.uint64)
        for j, term in enumerate(item):
            bits[self.holders[self.bounds[term] : self.bounds[term + 1]], j // 64] |= np.uint64(1 << j % 64)
        found = np.flatnonzero(bits.any(axis=1))
        if bits.shape[1] == 1:
            distinct, group = np.unique(bits[found, 0], return_inverse=True)
            return distinct[:, None], group, found
        distinct, group = np.unique(bits[found], axis=0, return_inverse=True)
        return distinct, group.reshape(-1), found

    def search(self, item: np.ndarray, best: _Best) -> int:
        """Adds the block's documents that may be among the best of the item; how many were scored."""
        item = item[self.most[item] > 0]
        if not len(item):
            return 0
        masks, group, found = self.masks(item)
        bound = np.zeros(len(masks), np.int64)
        for j, term in enumerate(item):
            bound += np.where(masks[:, j // 64] >> np.uint64(j % 64) & np.uint64(1), self.most[term], 0)
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(masks), np.int64)
        place[order] = np.arange(len(masks))
        rows = np.argsort(place[group], kind="stable")
        found, upper = found[rows], bound[order][place[group][rows]]
        ends = np.cumsum(np.bincount(place[group]))  # documents up to each mask
        self.wanted[item] = True
        at = 0
        while at < len(found) and upper[at] >= best.floor():
            # whole masks, at least one, none below the floor
            mask = max(np.searchsorted(ends, max(4 * best.k, 2 * at), "right") - 1, np.searchsorted(ends, at, "right"))
            to = min(int(ends[mask]), int(np.searchsorted(-upper, -best.floor(), "right")))
            scores = self.scores(found[at:to])
            good = scores >= best.floor()
            best.add(scores[good], self.docs[found[at:to][good]])
            at = to
        self.wanted[item] = False
        return at

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Scores of documents for the wanted terms."""
        size = self.ends[rows] - self.starts[rows]
        after = np.cumsum(size)
        places = np.arange(after[-1]) + np.repeat(self.starts[rows] - (after - size), size)
        sums = np.concatenate([[0], np.cumsum(np.where(self.wanted[self.terms[places]], self.parts[places], 0))])
        return sums[after] - sums[after - size]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``BLOCK`` postings at most."""
    size = np.diff(batch.column(2).offsets.to_numpy())
    part = np.cumsum(size) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def _search(rows: DataFrame, items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_all: int, k: int) -> DataFrame:
    none = np.iinfo(np.int64).max  # stands for a null id, which is last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_Best(k) for _ in items]
        for batch in (b for x in batches if x.num_rows for b in _blocks(x)):
            lists = batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            terms = lists.values.to_numpy()[ends[0] : ends[-1]]
            tf = batch.column(3).values.to_numpy()[ends[0] : ends[-1]]
            m = np.array([10 + 90 * n * n_docs // n_all for n in batch.column(1).to_pylist()], np.int64)
            ends = ends - ends[0]
            of = np.repeat(m, np.diff(ends))
            parts = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * of))
            ids = batch.column(0).fill_null(none).to_numpy()
            block = Block(ids, ends[:-1], ends[1:], terms, parts, len(weight))
            for item, best in zip(items, found):
                block.search(item, best)
        ix = np.repeat(np.arange(len(items)), [len(b.docs) for b in found])
        docs, scores = (np.concatenate([getattr(b, c) for b in found] or [np.zeros(0, np.int64)]) for c in ("docs", "scores"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ix), pa.array(docs, mask=docs == none), pa.array(scores)], names=["ix", "doc_id", "score"])

    return rows.mapInArrow(run, "ix long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, of those with a score above 0.

    Rows of ``items`` (item_id, text) with one id are one item of all their
    terms, a null id too; null, empty and unmatched texts find nothing. Each
    row of ``docs`` (doc_id, text) is a document, repeated ones too; those
    without a term are not counted. Equal scores rank by doc_id, null ids
    last. Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    terms = materialize(_item_terms(items))
    n_blocks = max(1, math.ceil(terms.count() / TERMS))
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
    kind = items.schema["item_id"]
    out = [_ranked(docs, terms.filter(F.col("block") == b).collect(), kind, k) for b in range(n_blocks)]
    shape = T.StructType([items.schema["item_id"], *T.StructType.fromDDL("rank int, doc_id long, score long").fields])
    empty = spark.createDataFrame([], shape)
    return reduce(DataFrame.unionByName, [x for x in out if x is not None], empty)


def _ranked(docs: DataFrame, pairs: list, kind: T.StructField, k: int) -> DataFrame | None:
    if not pairs:
        return None
    words = sorted({r["term"] for r in pairs})
    number = {w: i for i, w in enumerate(words)}
    ids = list(dict.fromkeys(r["item_id"] for r in pairs))
    of = {i: [] for i in ids}
    for r in pairs:
        of[r["item_id"]].append(number[r["term"]])
    rows = materialize(postings(docs, {w.encode("utf-8", "surrogatepass"): i for w, i in number.items()}))
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    if not total["docs"]:
        return None
    df = np.zeros(len(words), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    top = 2.0 * total["docs"] + 2
    weight = np.array([math.floor(1000 * math.log(top / (2.0 * d + 1))) for d in df.tolist()], np.int64)
    best = _search(rows, [np.array(of[i]) for i in ids], weight, total["docs"], total["words"], k)
    best = best.withColumn("part", F.spark_partition_id() % 64)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for by in (["ix", "part"], ["ix"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("ix", T.LongType()), kind]))
    return best.join(names, "ix").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH t AS (
  SELECT rowid_ AS d, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
p AS (SELECT d, doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2, 3),
n AS (SELECT d, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM n),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c),
s AS (
  SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN n USING (d), c GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""
