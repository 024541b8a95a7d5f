"""An inverted index with impacts, and ranked search in it by block maxima.

Documents are dealt to segments of about ``SEGMENT`` by a hash of their id and
numbered within their segment by length. A row of the index holds one term's
postings in one segment: numbers, impacts and the greatest impact; so a common
term is spread over as many rows as there are segments. Rows are bucketed by a
hash of the term, so a search reads the buckets of its terms only.

BM25Plus has a part that depends on document and term, the impact, and a part
of the query alone. A search takes the rows of its terms by segment, bounds
each range of ``RANGE`` documents by the greatest impacts there, and scores
the documents of the terms that add most until no other can enter the best
``k``, leaving out those of ranges whose bound is too low.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from herald.functions.text import tokens
from herald.sources.scratch import new_path, written

#: BM25Plus as published (fixed values).
K1, B, DELTA = 1.5, 0.75, 1.0
#: Documents of a segment, about; documents of a range; buckets of terms; queries that are searched together.
SEGMENT, RANGE, BUCKETS, QUERIES = 65_536, 128, 64, 4096
#: Documents that are scored at once, the share of a segment's documents from which on a term's impacts are laid out by document, and
#: terms of which this is kept.
FEW, DENSE, MOST_DENSE = 4096, 64, 64
#: Digits of a score.
DIGITS = 6


@dataclass
class Index:
    """``rows`` (segment, term, bucket, n, numbers, impacts, most, docs) in the shared folder; the row without term has a segment's ids."""

    rows: DataFrame
    docs: int
    segments: int


@dataclass
class Search:
    """A block of queries: the numbers and weights of their terms, and the part of a score that all documents share."""

    ids: list
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    shared: np.ndarray
    rows: DataFrame | None


def build(corpus: DataFrame, doc: str = "doc_id", text: str = "text", segment: int | None = None) -> Index:
    """Index of ``corpus`` (doc, text). Texts are split once; null texts are documents without terms.

    Ids are integers and distinct. What follows the written words is one
    shuffle by segment: numbers, counts and postings are made where it puts
    them, and no group is larger than a segment.
    """
    words = corpus.select(F.col(doc).cast("long").alias("doc"), tokens(text).alias("words"))
    base = written(words.withColumn("dl", F.size("words")), "words")
    size = base.agg(F.count("*").alias("n"), F.avg("dl").alias("dl")).first()
    segments = max(1, -(-size["n"] // (segment or SEGMENT)))
    dealt = base.withColumn("segment", F.pmod(F.xxhash64("doc"), F.lit(segments)).cast("int")).repartition("segment")
    number = F.row_number().over(Window.partitionBy("segment").orderBy("dl", "doc")) - 1
    dealt = dealt.withColumn("number", number)
    split = dealt.select("segment", "number", "dl", F.explode("words").alias("term"))
    counted = split.groupBy("segment", "number", "dl", "term").agg(F.count("*").alias("tf"))
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(size["dl"] or 1.0))
    impact = F.col("tf") * (K1 + 1) / (norm + F.col("tf"))
    row = counted.withColumn("impact", impact).groupBy("segment", "term").agg(
        F.sort_array(F.collect_list(F.struct("number", "impact"))).alias("p"), F.max("impact").alias("most"))
    rows = row.select(
        "segment", "term", F.size("p").alias("n"), F.col("p.number").alias("numbers"), F.col("p.impact").alias("impacts"), "most",
        F.expr("cast(null as array<bigint>)").alias("docs"))
    ids = dealt.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("number", "doc"))).alias("p")).select(
        "segment", F.lit("").alias("term"), F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("numbers"),
        F.expr("cast(array() as array<double>)").alias("impacts"), F.lit(0.0).alias("most"), F.col("p.doc").alias("docs"))
    path = new_path(corpus.sparkSession, "index")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    out = rows.unionByName(ids).withColumn("bucket", bucket)
    out.repartition("bucket", "segment").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    return Index(corpus.sparkSession.read.schema(out.schema).parquet(path), size["n"], segments)


def searches(index: Index, queries: DataFrame) -> Iterator[Search]:
    """The queries (query_id, text) in blocks, with the index rows of each block's terms.

    Only the terms of a block of a stated query set go to the driver and to
    tasks. Queries of which no term is in the index are left out.
    """
    spark = queries.sparkSession
    terms = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    terms = written(terms, "terms")
    df = index.rows.filter("term != ''").select("term", "n").join(terms.select("term").distinct(), "term", "left_semi")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    known = terms.join(df.groupBy("term").agg(F.sum("n").alias("df")), "term").withColumn("bucket", bucket)
    known = written(known.select("query_id", "term", "qf", "df", "bucket"), "known")
    ids = (r["query_id"] for r in known.select("query_id").distinct().orderBy("query_id").toLocalIterator())
    own_bucket = spark.range(1).select(F.lit("").alias("term")).select(bucket).first()[0]  # that of the segments' ids
    while some := list(islice(ids, QUERIES)):
        own = known.filter(F.col("query_id").between(some[0], some[-1])).toArrow()
        words, query = own["term"].to_pylist(), own["query_id"].to_numpy()
        number = {t: i for i, t in enumerate(sorted(set(words)))}  # by name, so that sums are added up in one order in all searches
        t = np.array([number[x] for x in words])
        weight = own["qf"].to_numpy() * np.log((index.docs + 1) / own["df"].to_numpy())
        order = np.lexsort((t, query))
        cut = np.flatnonzero(np.diff(query[order])) + 1
        weights = np.split(weight[order], cut)
        buckets = sorted({own_bucket, *own["bucket"].to_pylist()})
        named = spark.createDataFrame([("", -1), *number.items()], "term string, t int")
        rows = index.rows.filter(F.col("bucket").isin(buckets)).join(F.broadcast(named), "term")  # the terms of one block of queries
        yield Search(
            some, np.split(t[order], cut), weights, np.array([DELTA * w.sum() for w in weights]),
            rows.select("segment", "t", "numbers", "impacts", "docs"))


class _Segment:
    """The postings of a segment, by number of the term."""

    def __init__(self, table: pa.Table):
        self.docs, self.postings = np.zeros(0, np.int64), {}
        for batch in table.to_batches():
            t = batch.column("t").to_pylist()
            numbers, impacts, docs = (batch.column(c) for c in ("numbers", "impacts", "docs"))
            for i, term in enumerate(t):
                if term < 0:
                    self.docs = docs[i].values.to_numpy()
                else:
                    self.postings[term] = numbers[i].values.to_numpy(), impacts[i].values.to_numpy()
        self.ranges = -(-len(self.docs) // RANGE)
        self.maxima, self.dense = {}, {}
        for term, (numbers, impacts) in self.postings.items():
            of = numbers // RANGE
            at = np.flatnonzero(np.diff(of, prepend=-1))
            self.maxima[term] = of[at], np.maximum.reduceat(impacts, at), np.append(at, len(of))

    def sums(self, terms: np.ndarray, weights: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the documents with a term, sums); those of some ranges only, if these are given as flags."""
        total, met = np.zeros(len(self.docs)), np.zeros(len(self.docs), bool)
        for t, w in zip(terms.tolist(), weights.tolist()):
            if t not in self.postings:
                continue
            numbers, impacts = self.postings[t]
            if only is not None:
                of, _, at = self.maxima[t]
                take = np.repeat(only[of], np.diff(at))
                numbers, impacts = numbers[take], impacts[take]
            total[numbers] += w * impacts
            met[numbers] = True
        found = np.flatnonzero(met)
        return found, total[found]

    def _scores(self, terms: np.ndarray, weights: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The sums of some documents, added up in the order of :meth:`sums`."""
        total = np.zeros(len(some))
        for t, w in zip(terms.tolist(), weights.tolist()):
            if t not in self.postings:
                continue
            numbers, impacts = self.postings[t]
            if DENSE * len(numbers) > len(self.docs):
                if t not in self.dense:
                    if len(self.dense) >= MOST_DENSE:
                        del self.dense[next(iter(self.dense))]
                    self.dense[t] = np.zeros(len(self.docs))
                    self.dense[t][numbers] = impacts
                total += w * self.dense[t][some]
            else:
                at = np.minimum(np.searchsorted(numbers, some), len(numbers) - 1)
                total += w * np.where(numbers[at] == some, impacts[at], 0.0)
        return total

    def best(self, terms: np.ndarray, weights: np.ndarray, shared: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the ``k`` best, and in how many ranges documents were scored.

        The documents of the term that can add most come first. When all terms
        left could not lift a document into the ``k`` best, no other document
        can; nor can those of a range whose bound is too low.
        """
        bound, most = np.zeros(self.ranges), []
        for t, w in zip(terms.tolist(), weights.tolist()):
            if t in self.maxima:
                of, greatest, _ = self.maxima[t]
                bound[of] += w * greatest
                most.append((w * greatest.max(), t))
        most.sort(reverse=True)
        rest = np.cumsum([m for m, _ in most][::-1])[::-1]
        ids, scores, met, ranges = np.zeros(0, np.int64), np.zeros(0), np.zeros(len(self.docs), bool), np.zeros(self.ranges, bool)
        for (_, t), left in zip(most, rest.tolist()):
            least = scores[-1] - 10.0**-DIGITS if len(ids) == k else -np.inf
            if shared + left <= least:
                break
            some = self.postings[t][0]
            some = some[~met[some]]
            met[some] = True
            order = np.argsort(-bound[some // RANGE], kind="stable") if len(some) > FEW else slice(None)
            for part in np.array_split(some[order], -(-len(some) // FEW)) if len(some) else ():
                part = part[shared + bound[part // RANGE] > least]
                if not len(part):
                    break
                ranges[part // RANGE] = True
                ids = np.append(ids, self.docs[part])
                scores = np.append(scores, np.round(shared + self._scores(terms, weights, part), DIGITS))
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
                least = scores[-1] - 10.0**-DIGITS if len(ids) == k else -np.inf
        return ids, scores, int(ranges.sum())


def _by_segment(search: Search, run: Callable[[_Segment, Search], pa.Table], schema: str) -> DataFrame:
    """``run`` of each segment and the search's plain data."""
    plain = replace(search, rows=None)
    return search.rows.groupBy("segment").applyInArrow(lambda table: run(_Segment(table), plain), schema)


def search(index: Index, queries: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """(query_id, doc, score, rank): the ``k`` best documents of each query that share a term with it; equal scores by id."""
    return top(scored(index, queries, k, doc), k, doc)


def scored(index: Index, queries: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """(query_id, doc, score): the ``k`` best of each segment."""
    out = None
    for s in searches(index, queries):
        def run(segment: _Segment, s: Search) -> pa.Table:
            found = [segment.best(t, w, c, k)[:2] for t, w, c in zip(s.terms, s.weights, s.shared)]
            ids = np.repeat(np.array(s.ids, np.int64), [len(x) for x, _ in found])
            return pa.table({
                "query_id": ids, doc: np.concatenate([x for x, _ in found]), "score": np.concatenate([y for _, y in found])})

        part = _by_segment(s, run, f"query_id long, {doc} long, score double")
        out = part if out is None else out.unionByName(part)
    return queries.sparkSession.createDataFrame([], f"query_id long, {doc} long, score double") if out is None else out


def top(rows: DataFrame, k: int, doc: str) -> DataFrame:
    """The ``k`` best rows of each query with their rank; equal scores by id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(doc))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def places(index: Index, queries: DataFrame, pairs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``pairs`` (query_id, doc) with ``rank``: the place of the document in the query's list of all documents.

    Documents without a term of the query follow all others, by id. First the
    scores of the pairs are read from their segments, then each segment counts
    its documents before each pair, and the counts are added up. A query of
    which no term is indexed has no list and no row.
    """
    out = None
    spark = pairs.sparkSession
    for s in searches(index, queries):
        asked = pairs.join(spark.createDataFrame([(i,) for i in s.ids], "query_id long"), "query_id")
        wanted: dict = {}
        for r in asked.collect():  # of a block of queries, a few each
            wanted.setdefault(r["query_id"], []).append(r[doc])
        if not wanted:
            continue
        wanted = {i: np.array(sorted(set(d)), np.int64) for i, d in wanted.items()}

        def score(segment: _Segment, s: Search) -> pa.Table:
            out = []
            for i, t, w, c in zip(s.ids, s.terms, s.weights, s.shared):
                own = np.flatnonzero(np.isin(segment.docs, wanted.get(i, ())))
                if len(own):
                    found, sums = segment.sums(t, w)
                    total = np.full(len(segment.docs), c)
                    total[found] += sums
                    out += [(i, int(segment.docs[n]), float(np.round(total[n], DIGITS))) for n in own]
            return pa.table({
                "query_id": pa.array([x[0] for x in out], pa.int64()), doc: pa.array([x[1] for x in out], pa.int64()),
                "score": pa.array([x[2] for x in out], pa.float64())})

        scores: dict = {}
        for r in _by_segment(s, score, f"query_id long, {doc} long, score double").collect():
            scores.setdefault(r["query_id"], []).append((r[doc], r["score"]))

        def count(segment: _Segment, s: Search) -> pa.Table:
            ids, docs, before = [], [], []
            for i, t, w, c in zip(s.ids, s.terms, s.weights, s.shared):
                if i not in scores:
                    continue
                found, sums = segment.sums(t, w)
                total = np.full(len(segment.docs), np.round(c, DIGITS))
                total[found] = np.round(c + sums, DIGITS)
                for d, x in scores[i]:
                    ids.append(i)
                    docs.append(d)
                    before.append(int(np.count_nonzero((total > x) | ((total == x) & (segment.docs < d)))))
            return pa.table({c: pa.array(x, pa.int64()) for c, x in (("query_id", ids), (doc, docs), ("before", before))})

        part = _by_segment(s, count, f"query_id long, {doc} long, before long")
        part = part.groupBy("query_id", doc).agg((F.sum("before") + 1).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"query_id long, {doc} long, rank long") if out is None else out
