"""Impact index, metric index and exact fusion against full lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from herald.operators import fusion, impact_index, metric_index, retrieval


def texts(n, seed=1):
    random.seed(seed)
    common, rare = ["sinh", "viên", "học", "phí"], [f"từ{i}" for i in range(80)]
    rows = [(i, " ".join(random.choices(common, k=random.randint(0, 12)) + random.choices(rare, k=random.randint(0, 9)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "sinh viên"), (n + 3, "sinh viên")]


def clustered(n, size=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    x = centres[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, size))
    x[n // 2] = x[0]  # a tie
    return [(i, [float(v) for v in r / np.linalg.norm(r)]) for i, r in enumerate(x)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(texts(500), "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "sinh viên từ3 từ4"), (2, "học phí"), (3, "từ7 từ7 từ8"), (4, "không có gì"), (5, None), (6, "SINH sinh từ1")]
    return spark.createDataFrame(rows, "query_id long, text string").cache()


@pytest.fixture(scope="module")
def index(corpus):
    return impact_index.build(corpus, segment=100)


def listed(df, doc):
    return sorted((r["query_id"], r["rank"], r[doc], r["score"]) for r in df.collect())


def test_index_search_is_the_full_search(corpus, asked, index):
    assert index.docs == 504 and index.segments == 6
    for k in (1, 7, 1000):
        got, want = impact_index.search(index, asked, k), retrieval.bm25plus(corpus, asked, k)
        assert listed(got, "doc_id") == listed(want, "doc_id")


def test_places_among_all(spark, corpus, asked, index):
    full = {(r["query_id"], r["doc_id"]): r["rank"] for r in retrieval.bm25plus(corpus, asked, None, every=True).collect()}
    pairs = spark.createDataFrame([(q, d) for q in (1, 2, 3, 4) for d in (0, 17, 250, 500, 501, 503)], "query_id long, doc_id long")
    got = {(r["query_id"], r["doc_id"]): r["rank"] for r in impact_index.places(index, asked, pairs).collect()}
    assert got == {k: v for k, v in full.items() if k in {(q, d) for q in (1, 2, 3) for d in (0, 17, 250, 500, 501, 503)}}


def test_a_common_term_is_spread(index):
    """One row for each term and segment, and none has more postings than a segment has documents."""
    rows = index.rows.filter("term = 'sinh'")
    assert rows.count() == index.segments and rows.agg(F.sum("n")).first()[0] > 300
    assert index.rows.groupBy("segment", "term").count().filter("count > 1").isEmpty()


def test_ranges_are_passed_over():
    """A rare strong term keeps a segment's other ranges from being scored."""
    import pyarrow as pa

    n = 64 * impact_index.RANGE
    rare = np.arange(3)
    table = pa.table({
        "t": [-1, 0, 1], "numbers": pa.array([[], list(range(n)), rare.tolist()], pa.list_(pa.int32())),
        "impacts": pa.array([[], [0.1] * n, [2.0] * 3], pa.list_(pa.float64())), "docs": pa.array([list(range(n)), None, None], pa.list_(pa.int64()))})
    ids, scores, ranges = impact_index._Segment(table).best(np.array([0, 1]), np.array([1.0, 1.0]), 2.0, 3)
    assert ids.tolist() == [0, 1, 2] and np.allclose(scores, 4.1) and ranges <= 4


def test_index_edges(spark, asked, corpus):
    empty = impact_index.build(corpus.limit(0))
    assert impact_index.search(empty, asked, 5).count() == 0
    assert impact_index.search(impact_index.build(corpus), asked.limit(0), 5).count() == 0


def test_nearest_vectors(spark):
    rows = clustered(900) + [(5000, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 60 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).unionByName(
        spark.createDataFrame([(7777, None)], "query_id long, vector array<double>"))
    index = metric_index.build(v)
    for k in (1, 5, 2000):
        read = []
        got = metric_index.search(index, q, k, read=read)
        assert listed(got, "vec_id") == listed(retrieval.dense_search(v, q, k), "vec_id")
        if k == 5:
            assert read[0][0] < 0.35 * read[0][1]  # groups that cannot matter are not read
    full = {(r["query_id"], r["vec_id"]): r["rank"] for r in retrieval.dense_search(v, q, None).collect()}
    pairs = spark.createDataFrame([(q_, x) for q_ in (0, 60, 120, 7777) for x in (0, 1, 450, 899, 5000, 6000)], "query_id long, vec_id long")
    got = {(r["query_id"], r["vec_id"]): r["rank"] for r in metric_index.places(index, q, pairs).collect()}
    assert got == {k: full[k] for k in got} and len(got) == 12
    none = metric_index.build(v.limit(0))
    assert metric_index.search(none, q, 3).count() == 0 and metric_index.places(none, q, pairs).count() == 0


def test_bounds_hold(spark):
    v = spark.createDataFrame(clustered(300), "vec_id long, embedding array<double>").withColumn(
        "embedding", F.transform("embedding", lambda x: x * (1 + F.col("vec_id") % 3)))
    index = metric_index.build(v)
    q = np.random.default_rng(5).normal(size=(20, 16))
    low, high = metric_index.bounds(index, q)
    for r in index.rows.collect():
        s = q @ np.array(r["vector"])
        assert (low[:, r["group"]] <= s).all() and (s <= high[:, r["group"]]).all()


def test_fusion_is_that_of_full_lists(spark, corpus, asked, index):
    v = spark.createDataFrame(clustered(500), "doc_id long, embedding array<double>")
    vector = v.filter("doc_id in (3, 9, 30, 31)").select("embedding").collect()
    with_vector = spark.createDataFrame(
        [(r["query_id"], r["text"], vector[i]["embedding"] if i < 4 else None) for i, r in enumerate(asked.orderBy("query_id").collect())],
        "query_id long, text string, vector array<double>")
    dense = metric_index.build(v, "doc_id")
    lists = [
        retrieval.bm25plus(corpus, asked, None, every=True), retrieval.dense_search(v, with_vector.select("query_id", "vector"), None, "doc_id")]
    for every, k, depth in ((2, 10, 64), (40, 3, 16)):
        current = corpus.filter(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("doc"))
        rounds = []
        got = fusion.fuse_current([fusion.lexical(index), fusion.dense(dense)], with_vector, current, k, index.docs, depth, rounds)
        want = retrieval.rrf_current(lists, current.withColumnRenamed("doc", "doc_id"), k)
        a = sorted((r["query_id"], r["rank"], r["doc"], round(r["score"], 12)) for r in got.collect())
        assert a == sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 12)) for r in want.collect())
        assert rounds[0][1] == 6 and all(x[1] >= y[1] for x, y in zip(rounds, rounds[1:]))


def test_long_words_are_ranked(spark):
    """A word of 100,000 letters, and phrases that begin within words."""
    blob = "".join(random.Random(1).choices("abcdefgh0123", k=100_000))
    rows = [(1, "Red widget", "c", "x"), (2, blob, "c", "y"), (3, "infrared widget", "c", "z"), (4, "widgets", "c", "red gear"), (5, None, None, None)]
    n = spark.createDataFrame(rows, "notice_id long, title string, category string, text string")
    q = spark.createDataFrame([(1, "red widget"), (2, blob[500:560]), (3, "dget"), (4, "d"), (5, "")], "query_id long, text string")
    got = {(r.query_id, r.notice_id): r.score for r in retrieval.lexical_rank(n, q).collect()}
    assert got[1, 1] == 100 + 50 + 40 and got[1, 3] == 100 + 20 and got[2, 2] == 100
    assert {k for k in got if k[0] == 3} == {(3, 1), (3, 3), (3, 4)} and {k[1] for k in got if k[0] == 4} == {1, 2, 3, 4}


def test_sift_loses_nothing(spark):
    from herald.operators import sift

    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    keys = rows.filter("id % 97 = 0").select("h")
    left = sift.sift(rows, "h", keys, sift.bits_for(keys.count()))
    assert left.filter("id % 97 = 0").count() == keys.count() and left.count() < 1.1 * keys.count()
    assert sift.sift(rows, "h", keys.limit(0), sift.LEAST).count() == 0 and sift.bits_for(1 << 40) == sift.MOST


def test_search_in_the_stream(spark, tmp_path):
    """Each batch of messages is searched, compared and judged against indexes that were made once."""
    from herald.operators import searched
    from herald.streaming import jobs

    chunks = spark.createDataFrame(
        [(10 * i + v, i, v, v == 2, f"Thông báo {i}: Sinh viên đăng ký học phần trước ngày {v}{i}/10/2026", [float(i == j) for j in range(4)]) for i in range(4) for v in (1, 2)],
        "chunk_id long, notice_id long, version_id long, is_latest boolean, text string, embedding array<double>")
    obligations = spark.createDataFrame(
        [(i, 2, 0, "register", f"2{i}/10/2026", f"2026-10-2{i}", None) for i in range(4)],
        "notice_id long, version_id long, ordinal int, off_action string, off_deadline string, off_deadline_norm string, off_amount long")
    validity = chunks.select("notice_id", "version_id").withColumn("validity", F.lit("CURRENT"))
    messages = [(i, f"Sinh viên đăng ký học phần trước ngày 2{i if i < 3 else 9}/10/2026 thông báo {i}", [float(i == j) for j in range(4)]) for i in range(4)]
    schema, src, out = "message_id long, text string, vector array<double>", str(tmp_path / "m"), str(tmp_path / "v")
    verify = searched.verifier(searched.index_chunks(chunks, obligations, validity))
    for k in (0, 2):
        spark.createDataFrame(messages[k : k + 2], schema).coalesce(1).write.mode("append").parquet(src)
        jobs.verify_stream(jobs.read_stream(spark, src, schema), verify, out, str(tmp_path / "ck")).awaitTermination(300)
    got = {r.message_id: r.verdict for r in spark.read.parquet(out).collect()}
    assert got == {0: "VERIFIED", 1: "VERIFIED", 2: "VERIFIED", 3: "CONFLICT"}


def test_small_groups_have_one_file_each(spark):
    rows = clustered(400)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = metric_index.build(v)
    files = index.rows.select("group", F.input_file_name().alias("file")).distinct().groupBy("group").count()
    assert files.filter("count > 1").isEmpty() and files.count() == int((index.size > 0).sum()) and index.size.sum() == 400
    unit = v.select(retrieval.normalise("embedding").alias("e"))
    assert unit._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1  # the length, once for all elements


def test_a_task_keeps_the_best_only(spark, monkeypatch):
    """What a task gives for a query is no more than it asks for, over all groups that it reads, also when it often drops the others."""
    v = spark.createDataFrame(clustered(400), "vec_id long, embedding array<double>")
    index = metric_index.build(v, centres=40)
    q = np.array([r["embedding"] for r in v.orderBy("vec_id").limit(6).collect()])
    monkeypatch.setattr(metric_index, "FOUND", 50)
    monkeypatch.setattr(metric_index, "SCORES", 30)
    one = metric_index.Index(index.rows.coalesce(1), index.along, index.low, index.high, index.across, index.size)
    wanted = np.ones((6, len(index.size)), bool)
    got = metric_index._best(one, wanted, np.arange(6), q, np.full(6, -np.inf), 7, "query_id long, vec_id long, score double").collect()
    x = np.array([r["embedding"] for r in v.orderBy("vec_id").collect()])
    want = {(i, int(j)) for i in range(6) for j in np.lexsort((np.arange(400), -np.round(x @ q[i], 9)))[:7]}
    assert len(got) == 42 and {(r["query_id"], r["vec_id"]) for r in got} == want


def test_common_terms_are_not_added_up(monkeypatch):
    """Documents without the rare term, all of which share ranges with it, are not scored once the common terms cannot lift them."""
    import pyarrow as pa

    n, rare = 8 * impact_index.RANGE, np.arange(0, 8 * impact_index.RANGE, 100)
    table = pa.table({
        "t": [-1, 0, 1], "numbers": pa.array([[], list(range(n)), rare.tolist()], pa.list_(pa.int32())),
        "impacts": pa.array([[], [0.1] * n, [2.0] * len(rare)], pa.list_(pa.float64())), "docs": pa.array([list(range(n)), None, None], pa.list_(pa.int64()))})
    segment, scored = impact_index._Segment(table), []
    plain = segment._scores
    monkeypatch.setattr(segment, "_scores", lambda t, w, some: scored.append(len(some)) or plain(t, w, some))
    ids, scores, _ = segment.best(np.array([0, 1]), np.array([1.0, 1.0]), 2.0, 5)
    assert ids.tolist() == [0, 100, 200, 300, 400] and np.allclose(scores, 4.1) and sum(scored) == len(rare)


def test_blocks_of_queries_share_counts(spark, corpus, asked, index, monkeypatch):
    """Searches in blocks give what one block gives."""
    whole = listed(impact_index.search(index, asked, 9), "doc_id")
    monkeypatch.setattr(impact_index, "QUERIES", 2)
    assert len(list(impact_index.searches(index, asked))) == 2 and listed(impact_index.search(index, asked, 9), "doc_id") == whole
