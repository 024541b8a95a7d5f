"""Structured Streaming forms: ingest, event dedupe, windows, failure streaks, message verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from herald.operators import versions
from herald.operators.monitoring import MAX_DOUBLINGS
from herald.sources.pages import dead_letters


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def ingest_versions(observations: DataFrame, table: str, checkpoint: str, key: list[str] | None = None, parts: int = 64) -> StreamingQuery:
    """Append to the Parquet table what it lacks by (notice_key, content_hash); a batch that comes again adds nothing.

    The table is partitioned by a hash of the key, so that a batch is compared
    with the partitions of its own keys only.
    """
    key = key or ["notice_key", "content_hash"]

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*key).agg(F.min("observed_at").alias("observed_at")).withColumn(
            "part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
        )
        if _exists(spark, table):
            mine = [r["part"] for r in new.select("part").distinct().collect()]  # at most ``parts`` numbers
            new = new.join(spark.read.parquet(table).filter(F.col("part").isin(mine)).select(*key), key, "left_anti")
        new.write.mode("append").partitionBy("part").parquet(table)

    return observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_notices(observations: DataFrame, folder: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Keep the tables of a stream of observations below ``folder``: log, versions, heads, discoveries and dead letters.

    Each batch is written to its own folder ``batch=<id>``, with overwrite, so
    a batch that is run again replaces itself. Rows with an ``error`` go to the
    dead letters, others to the log. Versions, heads and discoveries of a batch
    are those of the notices it touches, from all of their log: of several
    states of a notice the one of the latest batch counts (:func:`latest`). The
    log is partitioned by a hash of the notice, so that only the partitions of
    touched notices are read again.
    """
    part = F.pmod(F.xxhash64("notice_key"), F.lit(parts)).cast("int")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        put(dead_letters(batch.filter("error is not null"), "ingest", "PARSE_ERROR", F.col("error"), F.col("observed_at")), "dead_letters")
        good = batch.filter("error is null").drop("error").withColumn("part", part)
        good.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/log/batch={batch_id}")
        mine = [r["part"] for r in good.select("part").distinct().collect()]  # at most ``parts`` numbers
        log = spark.read.schema(good.drop("part").schema.add("batch", T.LongType()).add("part", T.IntegerType())).parquet(f"{folder}/log")
        log = log.filter(F.col("part").isin(mine) & (F.col("batch") <= batch_id)).drop("batch", "part")
        touched = log.join(batch.select("notice_key").distinct(), "notice_key", "left_semi")
        known = versions.classify_changes(touched)
        put(versions.versions(known), "versions")
        put(versions.heads(known), "heads")
        put(versions.discoveries(touched), "discoveries")

    return observations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, name: str, key: list[str]) -> DataFrame:
    """The rows of the latest batch for each key of a table of :func:`ingest_notices`."""
    rows = spark.read.parquet(f"{folder}/{name}")
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def dedupe_events(events: DataFrame, keys: list[str], late: str = "48 hours") -> DataFrame:
    """Each event once within the watermark; state is dropped as it passes."""
    return events.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(keys)


def cycle_windows(checks: DataFrame, width: str = "600 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts of outcomes in tumbling windows."""
    w = checks.withWatermark("checked_at", late).groupBy(F.window("checked_at", width), "outcome").count()
    return w.select(F.col("window.start").alias("started_at"), "outcome", F.col("count").alias("n"))


def recent_activity(events: DataFrame, width: str = "48 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each notice in sliding windows."""
    w = events.withWatermark("observed_at", late).groupBy(F.window("observed_at", width, slide), "notice_id").count()
    return w.select(F.col("window.end").alias("at"), "notice_id", F.col("count").alias("n"))


def failure_streaks(checks: DataFrame, interval: int = 600) -> DataFrame:
    """(source_id, checked_at, consecutive_failures, delay_seconds) for each check as it comes, with one number of state for each source."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["checked_at", "check_id"])
        out = []
        for at, failed in zip(rows.checked_at, rows.failed):
            streak = streak + 1 if failed else 0
            out.append((key[0], at, streak, interval * 2 ** min(streak, MAX_DOUBLINGS)))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["source_id", "checked_at", "consecutive_failures", "delay_seconds"])

    return checks.groupBy("source_id").applyInPandasWithState(
        step, "source_id long, checked_at timestamp, consecutive_failures long, delay_seconds long", "streak long", "append",
        GroupStateTimeout.NoTimeout
    )


def verify_stream(messages: DataFrame, verify: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """Verify each batch of messages against the static tables that ``verify`` closes over, in a folder of its own: a batch that comes again replaces its verdicts."""

    def run(batch: DataFrame, batch_id: int) -> None:
        verify(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
