"""Retrieval over many queries at once: chunks, BM25Plus, dense cosine, rank fusion, lexical ranking."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herald.functions.text import fold_vietnamese, let, tokens
from herald.operators.versions import current_versions

#: BM25Plus as published (fixed values).
K1, B, DELTA = 1.5, 0.75, 1.0
#: Rank constant of reciprocal rank fusion (a fixed value).
RRF_K = 60


def chunks(text: str | Column, most: int = 500) -> Column:
    """array<struct<start_char, end_char, text>>: lines gathered into chunks.

    A blank line closes a chunk, and so does the line that brings the summed
    length of its lines over ``most``. A chunk's text is exactly that span.
    """
    lines = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)
    zero = F.expr(
        "named_struct('at', 0, 'from', -1, 'to', 0, 'size', 0, 'out', cast(array() as array<struct<start_char:int,end_char:int>>))"
    )

    def close(a: Column) -> Column:
        return F.when(
            a["from"] >= 0, F.array_append(a["out"], F.struct(a["from"].alias("start_char"), a["to"].alias("end_char")))
        ).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        n = F.length(x)
        blank = F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) == ""
        begun = F.when(a["from"] >= 0, a["from"]).otherwise(a["at"])
        grown = F.struct(begun.alias("from"), (a["at"] + n).alias("to"), a["out"].alias("out"))
        full = a["size"] + n > most
        after = (a["at"] + n + 1).cast("int").alias("at")
        state = lambda f, t, s, o: F.struct(
            after, f.cast("int").alias("from"), t.cast("int").alias("to"), s.cast("int").alias("size"), o.alias("out")
        )
        return F.when(blank, state(F.lit(-1), F.lit(0), F.lit(0), close(a))).when(full, state(F.lit(-1), F.lit(0), F.lit(0), close(grown))).otherwise(state(grown["from"], grown["to"], a["size"] + n, a["out"]))

    source = F.col(text) if isinstance(text, str) else text
    spans = F.aggregate(lines, zero, step, close)
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start_char"].alias("start_char"), s["end_char"].alias("end_char"),
            F.substring(source, s["start_char"] + 1, s["end_char"] - s["start_char"]).alias("text")
        )
    )


def chunk_versions(versions: DataFrame) -> DataFrame:
    """Chunks of rows (version_id, raw_text, ...): chunk_id ``{version}_{i}``, offsets, text, and the other columns."""
    rows = versions.select("*", F.posexplode(chunks("raw_text")).alias("i", "c"))
    return rows.select(
        F.concat_ws("_", "version_id", "i").alias("chunk_id"), F.col("i").alias("ordinal"), "c.*",
        *[c for c in versions.columns if c != "raw_text"]
    )


def build_corpus(version: DataFrame, head: DataFrame, notices: DataFrame, key: str = "notice_key") -> DataFrame:
    """Chunks of all versions (key, content_hash, version_id, raw_text) with their notice's columns and ``is_latest``.

    ``head`` (key, current_content_hash) tells the current content.
    ``publication_date`` is null: chunks are not ranked by it.
    """
    marked = current_versions(version, head, key).join(notices, key)
    return chunk_versions(marked).withColumn("publication_date", F.lit(None).cast("timestamp"))


def postings(corpus: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term, tf, dl): how often each term occurs, and the length of the document."""
    split = corpus.select(doc, tokens(text).alias("t"))
    return split.select(doc, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(doc, "term", "dl").agg(F.count("*").alias("tf"))


def bm25plus(corpus: DataFrame, queries: DataFrame, k: int | None, doc: str = "doc_id", every: bool = False) -> DataFrame:
    """(query_id, doc, score, rank) of the ``k`` best documents for each query, of all without ``k``.

    ``score = sum over query terms, with repeats, of ln((N + 1) / df) * (delta
    + tf * (k1 + 1) / (k1 * (1 - b + b * dl / avgdl) + tf))``. The delta part
    is the same for all documents of a query, so only documents that share a
    term are scored by the join of terms, and it is added after. Documents
    without any term of the query rank below all others; they are listed with
    ``every`` only, which pairs a stated set of queries with all documents.
    """
    size = corpus.agg(
        F.count("*").alias("n"), F.avg(F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w+"))).alias("avgdl")
    )
    terms = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    # only terms that some query has are kept of the documents, before any shuffle of postings
    wanted = terms.select("term").distinct()
    found = corpus.select(doc, tokens("text").alias("t")).select(
        doc, F.size("t").alias("dl"), F.explode("t").alias("term")
    ).join(wanted, "term", "left_semi").groupBy(doc, "dl", "term").agg(F.count("*").alias("tf"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weight = terms.join(df, "term").crossJoin(F.broadcast(size)).withColumn("w", F.col("qf") * F.log((F.col("n") + 1) / F.col("df")))  # size is one row
    whole = weight.groupBy("query_id").agg((DELTA * F.sum("w")).alias("every"))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (norm + F.col("tf"))
    scored = found.join(weight.select("query_id", "term", "w", "avgdl"), "term").groupBy("query_id", doc).agg(F.sum(part).alias("s"))
    if every:
        scored = corpus.select(doc).crossJoin(whole).join(scored, ["query_id", doc], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    else:
        scored = scored.join(whole, "query_id")
    scored = scored.withColumn("score", F.round(F.col("s") + F.col("every"), 6)).filter("score > 0")
    return top_k(scored.select("query_id", doc, "score"), k, doc)


def top_k(scored: DataFrame, k: int | None, doc: str = "doc_id") -> DataFrame:
    """The ``k`` best rows of each query with ``rank`` from 1, all without ``k``; equal scores by ``doc``."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(doc))
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def normalise(vector: str | Column) -> Column:
    """A vector of length 1; null where it has none."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))  # else the length would be worked out for each element


def dense_search(vectors: DataFrame, queries: DataFrame, k: int | None, vector_id: str = "vec_id", block: int = 1024) -> DataFrame:
    """(query_id, vector_id, score, rank): the ``k`` nearest by dot product for each query, all without ``k``; no floor.

    ``queries`` (query_id, vector) are a stated set of vectors; they go in
    blocks to each batch of ``vectors`` (vector_id, embedding), which keeps its
    own best ``k``, and those are ranked again. Null vectors are left out.
    """
    spark = vectors.sparkSession
    queries = queries.filter("vector is not null")
    rows = queries.orderBy("query_id").toLocalIterator()
    blocks: list = []
    while some := list(islice(rows, block)):  # a block of query vectors at a time
        ids = np.array([r["query_id"] for r in some], np.int64)
        blocks.append(spark.sparkContext.broadcast((ids, np.array([r["vector"] for r in some], dtype=np.float64))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(vector_id).to_numpy()
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
            for sent in blocks:
                ids, q = sent.value
                s = np.round(q @ x.T, 9)
                # all that equal the k-th of the batch, or are above: which of them stay is decided by id in the end
                all_ = k is None or len(own) <= k
                row, column = np.nonzero(s >= (-np.inf if all_ else -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(own[column]), pa.array(s[row, column])], names=["query_id", vector_id, "score"])

    found = vectors.select(F.col(vector_id).cast("long").alias(vector_id), "embedding").filter("embedding is not null")
    return top_k(found.mapInArrow(near, f"query_id long, {vector_id} long, score double"), k, vector_id)


def rrf(lists: list[DataFrame], k: int, doc: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc, rank): the sum of ``1 / (60 + rank)`` over the first ``2k`` of each.

    Ties go to what stands first in the earliest list.
    """
    all_ = None
    for i, ranked in enumerate(lists):
        part = ranked.filter(F.col("rank") <= 2 * k).select("query_id", doc, "rank", F.lit(i).alias("list"))
        all_ = part if all_ is None else all_.unionByName(part)
    scored = all_.groupBy("query_id", doc).agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first")
    )
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first", doc)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", doc, "score", "rank")


def rrf_current(lists: list[DataFrame], current: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """Fusion of full ranked lists over the documents in ``current`` (doc): the ranks are those among all documents."""
    kept = [ranked.join(current.select(doc).distinct(), doc, "left_semi") for ranked in lists]
    all_ = None
    for i, ranked in enumerate(kept):
        part = ranked.select("query_id", doc, "rank", F.lit(i).alias("list"))
        all_ = part if all_ is None else all_.unionByName(part)
    scored = all_.groupBy("query_id", doc).agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first")
    )
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first", doc)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", doc, "score", "rank")


def collapse_identity(ranked: DataFrame, identity: list[str]) -> DataFrame:
    """The first hit of each identity per query, ranked anew."""
    first = ranked.groupBy("query_id", *identity).agg(F.min("rank").alias("first_rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank")))


def vector_check(vectors: DataFrame, known: DataFrame, vector_id: str, size: int) -> DataFrame:
    """One row: vectors, those of another length, with values that are no numbers, or without a row in ``known``; and a digest of all."""
    wrong = F.size("embedding") != size
    bad = F.exists("embedding", lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf")))
    orphan = vectors.join(known.select(vector_id), vector_id, "left_anti").agg(F.count("*").alias("orphans"))
    return vectors.agg(
        F.count("*").alias("vectors"), F.count_if(wrong).alias("wrong_size"), F.count_if(bad).alias("not_finite"),
        F.bit_xor(F.xxhash64(vector_id, "embedding")).alias("digest")
    ).crossJoin(orphan)


def _runs(word: str, m: int) -> Column:
    """Runs of ``m`` letters of a word that has as many."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - (m - 1)), lambda i: F.substring(F.col(word), i, F.lit(m)))


def _candidates(n: DataFrame, q: DataFrame) -> DataFrame:
    """(query_id, notice_id) of notices that share a word with the query or could hold one of its phrases, by joins on words.

    A phrase may begin within a word: its first word is then the end of that
    word, or, if it has no other, any part of it. The distinct words are listed
    by their runs of one to three letters; a phrase's first run of three, or
    all of a shorter first word, finds the words that may hold it, and those
    are looked at. A word gives as many rows as it has letters, three times.
    """
    word = n.select(
        "notice_id", F.explode(F.array_distinct(F.split(F.concat_ws(" ", "title", "category", "body"), " "))).alias("word")
    ).filter("word != ''")
    known = word.select("word").distinct()
    runs = F.flatten(F.array(*[
        F.when(F.length("word") >= m, F.array_distinct(_runs("word", m))).otherwise(F.expr("cast(array() as array<string>)")) for m in (1, 2, 3)]))
    phrase = q.select("query_id", F.explode(F.array_union(F.array("q"), "syn")).alias("p")).filter("p != ''")
    phrase = phrase.select("query_id", F.substring_index("p", " ", 1).alias("part"), F.contains("p", F.lit(" ")).alias("more"))
    asked = phrase.select("part", "more").distinct().withColumn("run", F.left("part", F.lit(3)))
    inside = known.select("word", F.explode(runs).alias("run")).join(asked, "run").filter(
        F.when(F.col("more"), F.endswith("word", F.col("part"))).otherwise(F.contains("word", F.col("part")))).select("word", "part", "more")
    by_part = inside.join(phrase, ["part", "more"]).select("query_id", "word")
    by_word = q.select("query_id", F.explode("qt").alias("word"))
    return word.join(by_word.unionByName(by_part).distinct(), "word").select("query_id", "notice_id").distinct()


def lexical_rank(
    notices: DataFrame, queries: DataFrame, limit: int = 10, least: int = 40, synonyms: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """(query_id, notice_id, score, reasons, rank) of notices (notice_id, title, category, text) by folded wording.

    100 for the phrase in the title, else 80 for a synonym there; 50 if all
    words are title words; 15 for each category word, 20 for each title word;
    30 for the phrase or a synonym in the text, else 5 for each word there.
    Rows below ``least`` are dropped; ties by title, then id. Only notices that
    share a word with the query, or hold a phrase, can reach it: they are found
    by joins on words, and scored.
    """
    q = queries.select(
        "query_id", fold_vietnamese("text").alias("q")
    ).filter("q != ''").withColumn("qt", F.array_distinct(F.split("q", " ")))
    table = F.create_map(*[x for k, v in (synonyms or {"": ()}).items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    q = q.withColumn("syn", F.coalesce(F.try_element_at(table, F.col("q")), F.expr("cast(array() as array<string>)")))
    n = notices.select(
        "notice_id", fold_vietnamese("title").alias("title"), fold_vietnamese("category").alias("category"),
        fold_vietnamese("text").alias("body")
    )
    p = _candidates(n, q).join(n, "notice_id").join(q, "query_id")
    hits = lambda c: F.size(F.array_intersect("qt", F.split(c, " ")))
    p = p.withColumns({
        "phrase": F.contains("title", F.col("q")), "syn_title": F.exists(
            "syn", lambda s: F.contains(F.col("title"), s)
        ), "in_title": hits("title"), "in_category": hits("category"),
        "phrase_body": F.contains("body", F.col("q")) | F.exists("syn", lambda s: F.contains(F.col("body"), s)), "in_body": hits("body")})
    c = F.col
    all_title = c("in_title") == F.size("qt")
    score = F.when(c("phrase"), 100).when(c("syn_title"), 80).otherwise(0) + F.when(all_title, 50).otherwise(0) + 15 * c("in_category") + 20 * c("in_title") + F.when(c("phrase_body"), 30).otherwise(5 * c("in_body"))
    some_title = F.when((c("in_title") > 0) & ~(c("phrase") | c("syn_title") | all_title), "title words")
    reasons = F.array_compact(
        F.array(
            F.when(c("phrase"), "title phrase").when(c("syn_title"), "title synonym"), F.when(all_title, "all title words"),
            F.when(c("in_category") > 0, "category"), some_title,
            F.when(c("phrase_body"), "text phrase").when(c("in_body") > 0, "text words")
        )
    )
    rows = p.select("query_id", "notice_id", "title", score.alias("score"), reasons.alias("reasons")).filter(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "title", "notice_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("title")


def search_index(notices: DataFrame, sources: DataFrame, newest: DataFrame, activity: DataFrame) -> DataFrame:
    """Notices with their source's name as category, the newest text, and their recent activity if there is any."""
    rows = notices.join(sources.select("source_id", F.col("name").alias("category")), "source_id").join(
        newest.select("notice_id", F.col("raw_text").alias("text")), "notice_id", "left"
    )
    return rows.join(activity.select("notice_id", F.col("outcome").alias("recent")), "notice_id", "left")
