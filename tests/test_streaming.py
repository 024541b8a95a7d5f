from datetime import datetime, timedelta

from pyspark.sql import functions as F

from herald.streaming import jobs as S

T0 = datetime(2026, 1, 1)


def test_ingest_is_idempotent_and_streaks_keep_state(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "versions")
    rows = [("n", h, T0 + timedelta(hours=i)) for i, h in enumerate("aab")]
    schema = "notice_key string, content_hash string, observed_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(src)
    for k in range(2):  # a second run from the start sees the same files and adds nothing
        S.ingest_versions(S.read_stream(spark, src, schema), table, str(tmp_path / f"c{k}")).awaitTermination(120)
    assert spark.read.parquet(table).count() == 2

    checks, out = str(tmp_path / "checks"), str(tmp_path / "out")
    schema = "source_id long, checked_at timestamp, check_id long, failed boolean"
    for k, failed in enumerate([[True, True], [True, False, True]]):
        spark.createDataFrame(
            [(1, T0 + timedelta(minutes=10 * k + i), 10 * k + i, f) for i, f in enumerate(failed)], schema
        ).coalesce(1).write.mode("append").parquet(checks)
        q = S.failure_streaks(S.read_stream(spark, checks, schema)).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cs")
        ).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = [(r.consecutive_failures, r.delay_seconds) for r in spark.read.parquet(out).orderBy("checked_at").collect()]
    assert got == [(1, 1200), (2, 2400), (3, 4800), (0, 600), (1, 1200)]


def test_windows_are_streams(spark, tmp_path):
    schema = "notice_id long, outcome string, observed_at timestamp, checked_at timestamp"
    path = str(tmp_path / "e")
    spark.createDataFrame(
        [(1, "NEW", T0, T0), (1, "NEW", T0, T0), (2, "NEW", T0 + timedelta(days=9), T0 + timedelta(days=9))], schema
    ).write.parquet(path)
    e = S.read_stream(spark, path, schema)
    for df, name in (
        (S.dedupe_events(e, ["notice_id", "outcome", "observed_at"]), "dedupe"), (S.cycle_windows(e), "cycle"),
        (S.recent_activity(e), "recent")
    ):
        q = df.writeStream.format("memory").queryName(name).option(
            "checkpointLocation", str(tmp_path / name)
        ).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("dedupe").count() == 2
    assert spark.table("cycle").filter(F.col("n") == 2).count() == 1


def test_notices_stream_and_verdicts_by_batch(spark, tmp_path):
    src, folder = str(tmp_path / "obs"), str(tmp_path / "notices")
    schema = "notice_key string, normalized_url string, source_id long, content_hash string, title string, raw_text string, metadata string, observed_at timestamp, error string"
    batches = [
        [("n", "u", "a", None), ("m", "v", "x", None), (None, "w", None, "no date")], [("n", "u", "b", None), ("n", "mirror", "c", None)]
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(
            [(key, u, 1, h, "t", h, "{}", T0 + timedelta(hours=10 * k + i), e) for i, (key, u, h, e) in enumerate(rows)], schema
        ).coalesce(1).write.mode("append").parquet(src)
        stream = S.read_stream(spark, src, schema).withColumnRenamed("normalized_url", "url")
        S.ingest_notices(stream.withColumn("normalized_url", F.col("url")), folder, str(tmp_path / "ck")).awaitTermination(120)
    heads = {r.notice_key: r.current_content_hash for r in S.latest(spark, folder, "heads", ["notice_key"]).collect()}
    assert heads == {"n": "b", "m": "x"}
    assert {
        (r.notice_key, r.content_hash) for r in S.latest(spark, folder, "versions", ["notice_key", "content_hash"]).collect()
    } == {("n", "a"), ("n", "b"), ("m", "x")}
    assert S.latest(spark, folder, "discoveries", ["notice_key", "normalized_url"]).count() == 3
    assert [(r.url, r.message) for r in spark.read.parquet(folder + "/dead_letters").collect()] == [("w", "no date")]

    msgs, out = str(tmp_path / "m"), str(tmp_path / "verdicts")
    spark.createDataFrame([(1, "a"), (2, "b")], "message_id long, text string").write.parquet(msgs)
    for k in range(2):  # from the start again: the batch replaces its verdicts
        S.verify_stream(
            S.read_stream(spark, msgs, "message_id long, text string"),
            lambda b: b.select("message_id", F.lit("VERIFIED").alias("verdict")), out, str(tmp_path / f"v{k}")
        ).awaitTermination(120)
    assert sorted(r.message_id for r in spark.read.parquet(out).collect()) == [1, 2]
