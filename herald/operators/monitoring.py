"""Monitoring: outcomes of checks, failure streaks with back-off, events, activity, roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest back-off: the interval times two to this power (a fixed value).
MAX_DOUBLINGS = 4


def source_outcome(created: Column, updated: Column, failed: Column, unchanged: Column, duplicate: Column) -> Column:
    """NEW, UPDATED, FAILED (failures and nothing that held) or UNCHANGED."""
    return F.when(created > 0, "NEW").when(updated > 0, "UPDATED").when(
        (failed > 0) & (unchanged + duplicate == 0), "FAILED"
    ).otherwise("UNCHANGED")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "notice_id") -> DataFrame:
    """(key, outcome) of what is new or has other content in ``after``; what is gone is not reported."""
    old = before.select(key, F.col("content_hash").alias("__old"), F.lit(True).alias("__there"))
    joined = after.join(old, key, "left").filter("__there is null or not (__old <=> content_hash)")
    return joined.select(key, F.when(F.col("__there").isNull(), "NEW").otherwise("UPDATED").alias("outcome"))


def failure_streaks(checks: DataFrame, source: str = "source_id", interval: int = 600) -> DataFrame:
    """Each check with its source's consecutive failures, next_check_at, and the last change and error so far.

    ``checks``: source_id, checked_at, check_id, failed, changed, error. A
    success ends the streak and clears the error; the next check comes
    ``interval`` seconds later, doubled for each failure up to 16 times.
    """
    w = Window.partitionBy(source).orderBy("checked_at", "check_id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = checks.withColumn("__run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(upto))
    in_run = Window.partitionBy(source, "__run").orderBy("checked_at", "check_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streak = F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(in_run)
    out = run.withColumns({
        "consecutive_failures": streak, "last_error": F.when(F.col("failed"), F.col("error")),
        "last_changed_at": F.max(F.when(F.col("changed"), F.col("checked_at"))).over(upto)})
    delay = F.pow(F.lit(2), F.least(F.col("consecutive_failures"), F.lit(MAX_DOUBLINGS))).cast("long") * interval
    return out.withColumns({"delay_seconds": delay, "next_check_at": F.col("checked_at") + F.make_interval(secs=delay)}).drop("__run")


def source_state(checks: DataFrame, source: str = "source_id", interval: int = 600) -> DataFrame:
    """The last row of each source of :func:`failure_streaks`."""
    rows = failure_streaks(checks, source, interval)
    rest = [c for c in rows.columns if c not in (source, "checked_at", "check_id")]
    return rows.groupBy(source).agg(F.max(F.struct("checked_at", "check_id", *rest)).alias("s")).select(source, "s.*")


def latest_activity(events: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """The latest event of each notice by event_id, if it is at most ``hours`` old: the latest first, then the filter."""
    last = events.groupBy("notice_id").agg(F.max(F.struct("event_id", "outcome", "observed_at")).alias("e")).select("notice_id", "e.*")
    return last.filter(F.col("observed_at") >= now - F.make_interval(hours=F.lit(hours)))


def backfill_events(state: DataFrame, notices: DataFrame, version_counts: DataFrame, events: DataFrame) -> DataFrame:
    """Events missing for notices seen since their source last changed: UPDATED with several versions, else NEW."""
    since = notices.join(state.select("source_id", "last_changed_at"), "source_id").filter("last_observed_at >= last_changed_at")
    made = since.join(version_counts, "notice_id", "left").select(
        "notice_id", F.when(F.col("version_count") > 1, "UPDATED").otherwise("NEW").alias("outcome"),
        F.col("last_observed_at").alias("observed_at")
    )
    return made.join(events, ["notice_id", "outcome", "observed_at"], "left_anti")


def cycle_summary(checks: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Counts of outcomes in tumbling windows: started_at, new_count, updated_count, unchanged_count, failed_count."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(f"{o.lower()}_count")
    return checks.groupBy(F.window("checked_at", width).alias("w")).agg(*map(count, ("NEW", "UPDATED", "UNCHANGED", "FAILED"))).select(
        F.col("w.start").alias("started_at"), "new_count", "updated_count", "unchanged_count", "failed_count"
    )


def monitor_status(state: DataFrame) -> DataFrame:
    """One row: sources, those whose last outcome is not FAILED (none yet is healthy), and the last change."""
    healthy = F.coalesce(F.col("last_outcome") != "FAILED", F.lit(True))
    return state.agg(F.count("*").alias("sources"), F.count_if(healthy).alias("healthy"), F.max("last_changed_at").alias("last_changed_at"))


def skip_unmodified(fetched: DataFrame, seen: DataFrame, validators: list[str]) -> DataFrame:
    """Fetches whose URL and validators were not seen together before, null matching null."""
    s = seen.select(*[F.col(c).alias(f"__{c}") for c in ["url", *validators]]).distinct()
    same = F.lit(True)
    for c in ["url", *validators]:
        same = same & fetched[c].eqNullSafe(s[f"__{c}"])
    return fetched.join(s, same, "left_anti")


def changed_keys(events: DataFrame) -> DataFrame:
    """Notices whose chunks have to be made anew."""
    return events.filter(F.col("outcome").isin("NEW", "UPDATED")).select("notice_id").distinct()


def notice_events(events: DataFrame) -> DataFrame:
    """Each (notice_id, outcome, observed_at) once, with the least event_id it came by."""
    return events.groupBy("notice_id", "outcome", "observed_at").agg(F.min("event_id").alias("event_id"))


def utc(c: str | Column) -> Column:
    """Instant of an ISO text; without an offset it is UTC, whatever the session's zone. Null if it cannot be read."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    zoned = F.regexp_like(text, F.lit(r"(?i)(Z|[+-]\d{2}:?\d{2})$"))
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def rebuild_changed(stored: DataFrame, versions: DataFrame, events: DataFrame, chunk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stored`` chunks of unchanged notices, and ``chunk`` of the versions of those that events call new or updated.

    Without such events nothing is chunked.
    """
    changed = changed_keys(events)
    return stored.join(changed, "notice_id", "left_anti").unionByName(
        chunk(versions.join(changed, "notice_id", "left_semi")).select(*stored.columns)
    )
