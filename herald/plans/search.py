"""Registered queries: chunks and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from herald.functions.text import tokens
from herald.operators import fusion, impact_index, metric_index
from herald.operators import retrieval as R
from herald.plans.tables import table

_K = 5
#: Other wordings of part names, for the lexical ranking.
_SYNONYMS = {"red widget": ("gizmo", "plate"), "hot gear": ("old gear", "ot bolt")}


def chunk_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), F.col("text").alias("raw_text"))
    c = R.chunk_versions(d)
    return c.select(
        "chunk_id", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"),
        F.md5("text").alias("text_md5")
    )


def tokenize(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25plus(spark, sf_dir):
    """Documents for each benchmark passage: top five, as the search is one."""
    return R.bm25plus(
        table(spark, sf_dir, "documents").select("doc_id", "text"), _queries(spark, sf_dir), _K
    ).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_indexed(spark, sf_dir):
    """The same by an index of impacts, which is written once and searched by block maxima."""
    index = impact_index.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = impact_index.search(index, _queries(spark, sf_dir), _K)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _dense(spark, sf_dir, k):
    e = table(spark, sf_dir, "embeddings").select("vec_id", R.normalise("embedding").alias("embedding"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.dense_search(e, q, k)


def dense_topk(spark, sf_dir):
    """Nearest vectors of every vector whose id is divisible by 50, among all."""
    return _dense(spark, sf_dir, _K).select(
        "query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
    )


def _by_label(spark, sf_dir, k):
    """Another ranking of the same vectors: those of the query's label, by id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return R.top_k(
        e.join(F.broadcast(q), F.col("label") == F.col("own")).select(
            "query_id", "vec_id", (-F.col("vec_id")).cast("double").alias("score")
        ),
        k, "vec_id"
    )


def rank_fusion(spark, sf_dir):
    return R.rrf([_dense(spark, sf_dir, 2 * _K), _by_label(spark, sf_dir, 2 * _K)], _K, "vec_id").select(
        "query_id", "vec_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank")
    )


def _same_label(e):
    """The ranking of the vectors of a query's own label by id, the others left out; queries have ``own``."""
    known = e.select(F.col("vec_id").alias("doc"), "label")

    def best(queries, d):
        least = Window.partitionBy("label").orderBy("doc")  # the same for all queries of a label
        first = known.withColumn("rank", F.row_number().over(least)).filter(F.col("rank") <= d)
        rows = first.join(queries.select("query_id", "own"), F.col("label") == F.col("own"))
        return rows.select("query_id", "doc", (-F.col("doc")).cast("double").alias("score"), "rank")

    def places(queries, pairs):
        own = pairs.join(queries.select("query_id", "own"), "query_id").join(known, "doc").filter("label = own").drop("label")
        before = known.select(F.col("doc").alias("other"), "label")
        rows = own.join(before, (F.col("label") == F.col("own")) & (F.col("other") < F.col("doc")), "left")
        return rows.groupBy("query_id", "doc").agg((F.count("other") + 1).alias("rank"))

    return fusion.Ranking(best, places)


def rank_fusion_current(spark, sf_dir):
    """Fusion over two thirds of the vectors by their ranks among all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", R.normalise("embedding").alias("embedding"), "label")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("own"))
    index = metric_index.build(e)
    current = e.filter("vec_id % 3 != 0").select(F.col("vec_id").alias("doc"))
    found = fusion.fuse_current([fusion.dense(index), _same_label(e)], q, current, _K, int(index.size.sum()))
    return found.select(
        "query_id", F.col("doc").alias("vec_id"), F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def dense_indexed(spark, sf_dir):
    """The same nearest vectors by an index of groups."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", R.normalise("embedding").alias("embedding"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return metric_index.search(metric_index.build(e), q, _K).select(
        "query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def dense_places(spark, sf_dir):
    """Where each query's own label's least vectors stand in its list of all vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", R.normalise("embedding").alias("embedding"), "label")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("own"))
    first = _same_label(e).best(q, 3).select("query_id", F.col("doc").alias("vec_id"))
    return metric_index.places(metric_index.build(e), q, first)


def collapse_identity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    ranked = _dense(spark, sf_dir, 20).join(e, "vec_id")
    return R.collapse_identity(ranked, ["label"]).select(
        "query_id", "label", F.col("first_rank").cast("long").alias("first_rank"), F.col("rank").cast("long").alias("rank")
    )


def vector_check(spark, sf_dir):
    """Vectors of which some are cut short and some hold a value that is no number."""
    e = table(spark, sf_dir, "embeddings")
    broken = F.transform(
        "embedding", lambda x, i: F.when((F.col("vec_id") % 17 == 0) & (i == 3), F.lit(float("nan")).cast("float")).otherwise(x)
    )
    v = e.select("vec_id", F.when(F.col("vec_id") % 19 == 0, F.slice("embedding", 1, 63)).otherwise(broken).alias("embedding"))
    return R.vector_check(v, e.filter("vec_id % 10 != 3").select("vec_id"), "vec_id", 64).drop("digest")


def lexical_rank(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("notice_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"),
        F.concat_ws(" ", "p_brand", "p_name").alias("text")
    )
    q = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("query_id"))
    found = R.lexical_rank(n, q, 10, synonyms=_SYNONYMS)
    return found.select(
        "query_id", "notice_id", F.col("score").cast("long").alias("score"), F.array_join("reasons", ",").alias("reasons"),
        F.col("rank").cast("long").alias("rank")
    )


QUERIES = {
    f.__name__: f for f in (
        chunk_documents, tokenize, bm25plus, bm25_indexed, dense_topk, dense_indexed, dense_places, rank_fusion, rank_fusion_current,
        collapse_identity, vector_check, lexical_rank,
    )
}

_DENSE = """
WITH v AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
q AS (SELECT vec_id AS query_id, e AS qe, label AS own FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, label, round(list_dot_product(e, qe), 9) AS score FROM v, q),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
l AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank FROM v JOIN q ON label = own)
"""
_FUSE = """, u AS ({lists}),
f AS (SELECT query_id, vec_id, sum(1.0 / (60 + rank)) AS score, min(list * 1000000 + rank) AS first FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, vec_id) AS rank FROM f)
SELECT query_id, vec_id, round(score, 9) AS score, rank FROM r WHERE rank <= 5"""
_TOK = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: x <> '')"
SQL = {
    "chunk_documents": r"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
f AS (
  SELECT doc_id, ls, 1 AS i, 0 AS pos, -1 AS from_, 0 AS to_, 0 AS size, -1 AS cut_from, 0 AS cut_to, 0 AS n FROM l
  UNION ALL
  SELECT doc_id, ls, i + 1, pos + length(ls[i]) + 1,
    CASE WHEN trim(ls[i]) = '' OR size + length(ls[i]) > 500 THEN -1 WHEN from_ >= 0 THEN from_ ELSE pos END,
    pos + length(ls[i]), CASE WHEN trim(ls[i]) = '' OR size + length(ls[i]) > 500 THEN 0 ELSE size + length(ls[i]) END,
    CASE WHEN trim(ls[i]) = '' THEN from_ WHEN size + length(ls[i]) > 500 THEN (CASE WHEN from_ >= 0 THEN from_ ELSE pos END) ELSE -1 END,
    CASE WHEN trim(ls[i]) = '' THEN to_ ELSE pos + length(ls[i]) END, i
  FROM f WHERE i <= len(ls)),
c AS (
  SELECT doc_id, n, cut_from AS a, cut_to AS b FROM f WHERE cut_from >= 0
  UNION ALL SELECT doc_id, n + 1, from_, to_ FROM f WHERE i = len(ls) + 1 AND from_ >= 0)
SELECT c.doc_id || '_' || (row_number() OVER (PARTITION BY c.doc_id ORDER BY a) - 1) AS chunk_id, a::BIGINT AS start_char, b::BIGINT AS end_char, md5(d.text[a + 1:b]) AS text_md5
FROM c JOIN documents d ON c.doc_id = d.doc_id""",
    "tokenize": f"SELECT doc_id, len({_TOK.format('text')})::BIGINT AS n_tokens, len(list_distinct({_TOK.format('text')}))::BIGINT AS n_distinct FROM documents",
    "bm25plus": f"""
WITH t AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id AS query_id, unnest({_TOK.format('text')}) AS term FROM benchmark), qf AS (SELECT query_id, term, count(*) AS qf FROM q GROUP BY ALL),
w AS (SELECT query_id, term, qf * ln((n + 1) / df) AS w, avgdl FROM qf JOIN df USING (term), n),
e AS (SELECT query_id, sum(w) AS every FROM w GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(w * tf * 2.5::DOUBLE / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl) + tf)) + any_value(every), 6) AS score FROM tf JOIN w USING (term) JOIN e USING (query_id) GROUP BY 1, 2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""",
    "dense_topk": _DENSE + "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM d WHERE rank <= 5",
    "rank_fusion": _DENSE + _FUSE.format(
        lists="SELECT query_id, vec_id, rank, 0 AS list FROM d WHERE rank <= 10 UNION ALL SELECT query_id, vec_id, rank, 1 FROM l WHERE rank <= 10"
    ),
    "rank_fusion_current": _DENSE + _FUSE.format(
        lists="SELECT query_id, vec_id, rank, 0 AS list FROM d WHERE vec_id % 3 <> 0 UNION ALL SELECT query_id, vec_id, rank, 1 FROM l WHERE vec_id % 3 <> 0"
    ),
    "collapse_identity": _DENSE + ", c AS (SELECT query_id, label, min(rank) AS first_rank FROM d WHERE rank <= 20 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS rank FROM c",
    "lexical_rank": r"""
WITH n AS (SELECT p_partkey AS notice_id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS category, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')) AS body FROM part),
q AS (SELECT min(p_partkey) AS query_id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS q FROM part GROUP BY p_name),
h AS (SELECT *, list_distinct(string_split(q, ' ')) AS qt, CASE q WHEN 'red widget' THEN ['gizmo', 'plate'] WHEN 'hot gear' THEN ['old gear', 'ot bolt'] ELSE [] END AS syn FROM n, q),
m AS (
  SELECT query_id, notice_id, title, contains(title, q) AS phrase, len(list_filter(syn, lambda x: contains(title, x))) > 0 AS syn_title, len(list_intersect(qt, string_split(title, ' '))) AS t, len(list_intersect(qt, string_split(category, ' '))) AS c,
         contains(body, q) OR len(list_filter(syn, lambda x: contains(body, x))) > 0 AS phrase_body, len(list_intersect(qt, string_split(body, ' '))) AS b, len(list_intersect(qt, string_split(title, ' '))) = len(qt) AS every FROM h),
s AS (
  SELECT query_id, notice_id, title, (CASE WHEN phrase THEN 100 WHEN syn_title THEN 80 ELSE 0 END + CASE WHEN every THEN 50 ELSE 0 END + 15 * c + 20 * t + CASE WHEN phrase_body THEN 30 ELSE 5 * b END)::BIGINT AS score,
         concat_ws(',', CASE WHEN phrase THEN 'title phrase' WHEN syn_title THEN 'title synonym' END, CASE WHEN every THEN 'all title words' END, CASE WHEN c > 0 THEN 'category' END,
           CASE WHEN t > 0 AND NOT phrase AND NOT syn_title AND NOT every THEN 'title words' END, CASE WHEN phrase_body THEN 'text phrase' WHEN b > 0 THEN 'text words' END) AS reasons FROM m)
SELECT query_id, notice_id, score, reasons, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, notice_id) AS rank FROM s WHERE score >= 40 QUALIFY rank <= 10""",
    "vector_check": "SELECT count(*) AS vectors, count(*) FILTER (WHERE vec_id % 19 = 0) AS wrong_size, count(*) FILTER (WHERE vec_id % 17 = 0 AND vec_id % 19 <> 0) AS not_finite, count(*) FILTER (WHERE vec_id % 10 = 3) AS orphans FROM embeddings",
}
SQL["bm25_indexed"], SQL["dense_indexed"] = SQL["bm25plus"], SQL["dense_topk"]
SQL["dense_places"] = _DENSE + "SELECT query_id, vec_id, d.rank FROM d JOIN l USING (query_id, vec_id) WHERE l.rank <= 3"
