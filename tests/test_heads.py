"""Heads as keyed state against the fold over all observations."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from herald.operators import versions as V
from herald.streaming import heads as H
from herald.streaming import jobs as S

T0 = datetime(2026, 1, 1)


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a store of state for each, which take their time
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
SCHEMA = "notice_key string, normalized_url string, content_hash string, title string, raw_text string, publication_date string, observed_at timestamp"


def observations(spark, n, seed=4):
    random.seed(seed)
    rows = []
    for i in range(n):
        key = random.choice("abcdefgh")
        url = key if random.random() < 0.8 else f"{key}/mirror"
        title = random.choice(["Tin học phí", "Tin học phí Hot", "Tin học phí New", "Tin khác"])
        rows.append((key, url, title, random.choice(["x", "y"]), None, T0 + timedelta(minutes=i)))
    df = spark.createDataFrame(rows, "notice_key string, normalized_url string, title string, raw_text string, publication_date string, observed_at timestamp")
    full = V.content_hash(F.col("title"), F.col("publication_date"), F.col("raw_text"), F.lit(None).cast("array<string>"))
    return df.withColumn("content_hash", full).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def told(df):
    return sorted((r.notice_key, r.observed_at, r.outcome) for r in df.collect())


def heads(df):
    return sorted(
        (r.notice_key, r.current_content_hash, r.title, r.first_observed_at, r.last_observed_at) for r in df.collect())


def test_stream_is_the_fold(spark, tmp_path):
    rows = observations(spark, 240).cache()
    want = V.classify_changes(rows)
    src = str(tmp_path / "in")
    bounds = [T0 + timedelta(minutes=m) for m in (0, 130, 240)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = rows.filter((F.col("observed_at") >= F.lit(a)) & (F.col("observed_at") < F.lit(b)))
        part.coalesce(1).write.mode("append").parquet(src)
        folder = str(tmp_path / "out")
        H.ingest_heads(S.read_stream(spark, src, SCHEMA), folder, str(tmp_path / "ck")).awaitTermination(180)
        seen = rows.filter(F.col("observed_at") < F.lit(b))
        known = V.classify_changes(seen)
        assert told(spark.read.parquet(folder + "/changes")) == told(known)
    assert heads(S.latest(spark, folder, "heads", ["notice_key"])) == heads(V.heads(want))
    assert {r.outcome for r in want.collect()} == {"CREATED", "UPDATED", "UNCHANGED", "DUPLICATE"}
    got = sorted(map(tuple, H.versions_of(spark.read.parquet(folder + "/changes")).collect()))
    assert got == sorted(map(tuple, V.versions(want).collect()))
    assert spark.read.parquet(folder + "/changes").count() == 240  # each batch writes its own rows only


def test_stream_from_a_known_state(spark, tmp_path):
    rows = observations(spark, 160, 9).cache()
    cut = F.lit(T0 + timedelta(minutes=90))
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows.filter(F.col("observed_at") >= cut).write.parquet(src)
    initial = H.initial_heads(V.classify_changes(rows.filter(F.col("observed_at") < cut)))
    want = told(V.classify_changes(rows).filter(F.col("observed_at") >= cut))
    H.ingest_heads(S.read_stream(spark, src, SCHEMA), folder, str(tmp_path / "ck"), initial).awaitTermination(180)
    assert told(spark.read.parquet(folder + "/changes")) == want


def test_forgotten_notices_are_new(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", "u", "h", "t", "x", None, T0), (None, "u", "h", "t", "x", None, T0)]
    for k in range(2):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        H.ingest_heads(S.read_stream(spark, src, SCHEMA), folder, str(tmp_path / "ck"), ttl_ms=1).awaitTermination(180)
    assert [r.outcome for r in spark.read.parquet(folder + "/changes").collect()] == ["CREATED", "CREATED"]
