"""Near-duplicate documents: ProbMinHash signatures, bands, exact verification, components.

A document is its set of five-word shingles; two texts are linked when the
Jaccard similarity of these sets is 0.8 or more. A class is a connected
component of links, copies included.

ProbMinHash (Ertl, 2019) draws, for each shingle, a Poisson process of its
weight as rate; register ``k`` keeps the shingle of the first arrival that
falls on it. Two signatures agree at a register with the probability-Jaccard
similarity of the documents. All weights are one here, as what is verified are
sets: for these it is the Jaccard similarity, however often a shingle is
repeated. A shingle is left as soon as its next arrival comes after the latest
first arrival of all registers.

Bands of registers give candidate buckets. In each bucket all members are
checked against one centre, the member that shares most buckets; what is then
linked forms classes. Members of different classes that still share a bucket
are checked in pairs, but for those that exact bounds rule out:

- their sizes and their numbers of shingles found nowhere else;
- bitmaps of their shingles: two sets share at most the bits set in both, and
  the shingles that met others of their own set on a bit.

So no pair of a bucket is left open, and the members of one class are not
paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herald.llm._common import materialize, text_of, words
from herald.llm._shingles import blocks, components, distinct, lists, mix, shingles

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Arrivals that are drawn at once.
CHUNK = 100_000
#: Bits of a text's bitmap of shingles.
BITS = 2048


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """ProbMinHash signatures (n_docs x m) of weighted elements given as parallel arrays.

    An element that is repeated with the same weight counts once. Elements are
    drawn in chunks, so that memory beyond the signatures is bounded.
    """
    at, who = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    for i in range(0, len(element), CHUNK):
        _draw(at, who, doc[i: i + CHUNK], element[i: i + CHUNK], weight[i: i + CHUNK].astype(np.float64), m)
    return who.reshape(n_docs, m)


def _draw(at: np.ndarray, who: np.ndarray, doc: np.ndarray, element: np.ndarray, rate: np.ndarray, m: int) -> None:
    base, clock = mix(element + np.uint64(1)), np.zeros(len(element))
    alive, drawn, width, latest = np.arange(len(element)), 0, 1, np.zeros(len(at) // m)
    while len(alive):
        # arrivals number drawn .. drawn + width - 1 of each shingle still alive
        step = (np.arange(drawn, drawn + width, dtype=np.uint64) + np.uint64(1)) * _STEP
        bits = mix(base[alive, None] + step[None, :])
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
        when = clock[alive, None] + np.cumsum(gap, axis=1) / rate[alive, None]
        slot = doc[alive, None] * m + (mix(bits ^ _STEP) % np.uint64(m)).astype(np.int64)
        flat_when, flat_slot = when.ravel(), slot.ravel()
        np.minimum.at(at, flat_slot, flat_when)
        won = np.flatnonzero(flat_when == at[flat_slot])
        who[flat_slot[won]] = element[alive[won // width]]
        clock[alive] = when[:, -1]
        own = doc[alive]
        docs = own[np.concatenate([[True], own[1:] != own[:-1]])]
        latest[docs] = at.reshape(-1, m)[docs].max(axis=1)
        alive = alive[clock[alive] < latest[own]]
        drawn += width
        width = int(min(256, max(1, CHUNK // max(1, len(alive)))))


def _sign(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    m = bands * rows
    for batch in batches:
        values, lengths = lists(batch.column("words"))
        at = np.concatenate([[0], np.cumsum(lengths)])
        for i, j in blocks(lengths, m):
            doc, h = shingles(values[at[i]: at[j]], lengths[i:j], k)
            sig = signatures(doc, h, np.ones(len(h)), j - i, m)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (j - i, bands)).copy()
            for r in range(rows):
                key = mix(key * _STEP + sig[:, r::rows][:, :bands])
            has = lengths[i:j] > 0
            off = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
            part = batch.slice(i, j - i)
            out = pa.ListArray.from_arrays(off, pa.array(key[has].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), out], names=["doc_id", "t", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, lengths = lists(batch.column("words"))
        at = np.concatenate([[0], np.cumsum(lengths)])
        for i, j in blocks(lengths, BITS // 8):
            doc, h, _ = distinct(*shingles(values[at[i]: at[j]], lengths[i:j], k))
            n = j - i
            off = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
            bit = np.zeros((n, BITS), np.uint8)
            bit[doc, (h % np.uint64(BITS)).astype(np.int64)] = 1
            lanes = np.packbits(bit, axis=1).view(np.int64)
            spare = np.diff(off) - bit.sum(axis=1, dtype=np.int64)
            rows = np.arange(n + 1, dtype=np.int32) * (BITS // 64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.slice(i, n).column("t"), pa.ListArray.from_arrays(off, pa.array(h.view(np.int64))),
                    pa.ListArray.from_arrays(rows, pa.array(lanes.ravel())), pa.array(spare.astype(np.int32))
                ],
                names=["t", "shingles", "bits", "spare"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the Jaccard similarity of their sets, counted row by row in the JVM."""
    x = sets.select(F.col("t").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("t").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return both.select("a", "b", (F.col("both") / F.greatest(F.lit(1), F.size("x") + F.size("y") - F.col("both"))).alias("similarity"))


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 7) -> DataFrame:
    """One row (doc_id, class_id) for each row of ``docs`` (doc_id, text, any others).

    ``class_id`` is the least doc_id of the class, of the document itself if it
    stands alone. A null text counts as empty; equal texts, empty ones too, are
    copies. A text of fewer than ``k`` words is one shingle. A null doc_id
    takes part and is returned as null; repeated doc_ids are told apart by
    their texts. An empty table gives an empty result. Other columns, of
    whatever name, are not read.
    """
    return _classes(docs, k, similarity, bands, rows).select("doc_id", "class_id")


def _classes(docs: DataFrame, k: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 7) -> DataFrame:
    """Rows (doc_id, t, root, class_id); t is the digest of the text, root that of one text of the class."""
    rows_in = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), F.unhex(F.md5(text_of("text"))).alias("t")
    )
    hashed = rows_in.select("doc_id", "t", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    signed = materialize(hashed.mapInArrow(lambda it: _sign(it, k, bands, rows), "doc_id long, t binary, bands array<long>"))
    texts = materialize(signed.groupBy("t").agg(F.min("doc_id").alias("least"), F.min("bands").alias("bands")))
    place = texts.select("t", "least", F.explode("bands").alias("h"))
    bucket = place.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    # of each text that shares a bucket: its buckets, at most one for each band, and how many others are in these
    member = place.join(bucket, "h").groupBy("t").agg(
        F.min("least").alias("least"), F.sum("n").alias("w"), F.collect_list(F.struct("h", "n")).alias("at")
    )
    member = materialize(member)

    centre = member.select(
        "t", "w", F.explode("at.h").alias("h")
    ).groupBy("h").agg(F.max(F.struct("w", "t")).alias("c")).select("h", F.col("c.t").alias("a"))
    star = member.select(F.col("t").alias("b"), F.explode("at.h").alias("h")).join(centre, "h").filter("a != b").select("a", "b").distinct()
    chosen = member.select(F.col("t").alias("u"), "least")
    once = rows_in.join(chosen, F.expr("t = u and doc_id <=> least"), "left_semi").dropDuplicates(["t"])
    once = once.select("t", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    sets = materialize(once.mapInArrow(lambda it: _sets(it, k), "t binary, shingles array<long>, bits array<long>, spare int"))
    linked = materialize(_compared(star, sets).filter(F.col("similarity") >= similarity).select("a", "b"))
    roots = components(linked)
    more = _open_links(member, texts, roots, sets, similarity)
    if more is not None and not more.isEmpty():
        roots = components(linked.unionByName(more))

    placed = texts.join(roots.withColumnRenamed("node", "t"), "t", "left").select("t", "least", F.coalesce("root", "t").alias("root"))
    label = placed.join(placed.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("t", "root", "class_id")
    return signed.select("doc_id", "t").join(label, "t")


def _open_links(member: DataFrame, texts: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Links between texts that share a bucket and lie in different classes; bounds rule out pairs, the rest is verified."""
    named = roots.withColumnRenamed("node", "t")
    place = member.join(named, "t", "left").select(
        "t", F.coalesce("root", "t").alias("root"), F.explode(F.filter("at", lambda x: x["n"] > 2)).alias("x")
    )
    place = place.select("t", "root", F.col("x.h").alias("h"))
    by = place.groupBy("h", "root").agg(F.count("*").alias("c"))
    mixed = by.groupBy("h").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("classes")
    ).filter("classes > 1").select("h", "main")
    place = materialize(place.join(mixed, "h"))
    if place.isEmpty():
        return None
    # of each text: its shingles, and how many of them another text of these has too
    own = sets.join(place.select("t").distinct(), "t", "left_semi")
    seen = own.select("t", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("t").alias("t"))
    alone = seen.filter("c = 1").groupBy("t").agg(F.count("*").alias("alone"))
    size = own.select("t", "bits", "spare", F.size("shingles").alias("size")).join(alone, "t", "left")
    size = size.withColumn("shared", F.col("size") - F.coalesce("alone", F.lit(0))).filter(F.col("shared") >= similarity * F.col("size"))
    info = size.join(texts.select("t", "bands"), "t")
    rows = materialize(place.join(info, "t").select("h", "t", "root", "main", "size", "shared", "bands", "bits", "spare"))
    share = similarity / (1 + similarity) - 1e-9
    minor = rows.filter("root != main").select(*[F.col(c).alias(f"{c}_1") for c in rows.columns])
    # two sets of similarity s share s / (1 + s) of their sizes' sum; a pair is compared in its first common bucket
    fits = F.expr(f"""h = h_1 and root != root_1 and (root = main or t > t_1) and least(shared, shared_1) >= {share} * (size + size_1)
        and aggregate(zip_with(bits, bits_1, (x, y) -> bit_count(x & y)), 0, (n, x) -> n + x) + least(spare, spare_1) >= {share} * (size + size_1)
        and element_at(filter(zip_with(bands, bands_1, (x, y) -> if(x = y, x, null)), x -> x is not null), 1) = h""")
    pairs = minor.join(rows, fits).select(F.col("t_1").alias("a"), F.col("t").alias("b"))
    return materialize(_compared(pairs, sets).filter(F.col("similarity") >= similarity).select("a", "b"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class of :func:`near_duplicates`: the one of least doc_id.

    Rows that repeat both doc_id and text count once. All columns are kept.
    A row without a doc_id stays only if no row of its class has one.
    """
    one = F.min(F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "t")).alias("one")
    first = _classes(docs, **options).groupBy("root").agg(one).select(F.col("one.doc_id").alias("__id"), F.col("one.t").alias("__t"))
    keyed = docs.withColumn("__u", F.unhex(F.md5(text_of(docs["text"]))))
    kept = keyed.join(first, docs["doc_id"].cast("long").eqNullSafe(first["__id"]) & (F.col("__u") == F.col("__t")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__u"]).drop("__u")
