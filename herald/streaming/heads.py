"""Heads of notices as keyed state: each observation is classified against its notice's head, without the log.

The state of a notice is one value: its own URL, the current content and its
hash without badges, title and date, first and last time. It is bounded by the
number of notices, and with a time to live by those seen lately. What a batch
writes is bounded by its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from herald.operators.versions import without_badges

#: What is known of a notice.
HEAD = (
    "own_url string, plain string, badged_hash string, current_content_hash string, title string, publication_date string, "
    "first_observed_at long, last_observed_at long")
#: What is said of an observation.
CHANGE = (
    "notice_key string, normalized_url string, content_hash string, observed_at long, outcome string, current_content_hash string, "
    "title string, publication_date string, first_observed_at long, last_observed_at long, seq long")
#: Times of state and changes are microseconds of UTC inside.
_TIMES = ("observed_at", "first_observed_at", "last_observed_at")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Heads(StatefulProcessor):
    """Folds the observations of a notice into its head."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD, self.ttl_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.head.update(tuple(initialState[c.split()[0]] for c in HEAD.split(", ")))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        head = self.head.get() if self.head.exists() else None
        seq = 0
        for r in sorted(rows, key=lambda r: (r.observed_at, r.content_hash or "", r.normalized_url or "")):
            outcome, head = step(head, r)
            seq += 1
            _, _, _, current, title, date, first, last = head
            yield Row(
                notice_key=key[0], normalized_url=r.normalized_url, content_hash=r.content_hash, observed_at=r.observed_at, outcome=outcome,
                current_content_hash=current, title=title, publication_date=date, first_observed_at=first, last_observed_at=last, seq=seq)
        if head is not None:
            self.head.update(tuple(head))

    def close(self) -> None:
        pass


def step(head: tuple | None, r: Row) -> tuple[str, tuple]:
    """(outcome, head after it) of an observation: the rules of :func:`herald.operators.versions.classify_changes` as a fold."""
    if head is None:
        return "CREATED", (
            r.normalized_url, r.plain, r.content_hash if r.badged else None, r.content_hash, r.title, r.publication_date, r.observed_at, r.observed_at)
    own, plain, badged_hash, current, title, date, first, last = head
    if r.normalized_url != own:
        return "DUPLICATE", tuple(head)
    last = max(last, r.observed_at)
    if r.plain == plain and (not r.badged or r.content_hash == badged_hash):
        return "UNCHANGED", (own, plain, badged_hash, current, title, date, first, last)
    kept = badged_hash if r.plain == plain and not r.badged else r.content_hash if r.badged else None
    return "UPDATED", (own, r.plain, kept, r.content_hash, r.title, r.publication_date, first, last)


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which keyed processors need, for queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def changes(observations: DataFrame, initial: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Each observation of a stream (notice_key, normalized_url, content_hash, observed_at; title, publication_date, raw_text,
    attachments where known) with its outcome and the head after it.

    Observations of one batch are taken in the order of their time; one that
    comes in a later batch is later. ``initial`` has the columns of ``HEAD``
    and notice_key, as :func:`initial_heads` gives them. With ``ttl_ms``, a
    notice that was not written for so long is forgotten and then new again.
    Rows without a notice_key are left out.
    """
    badged, plain = without_badges(observations)
    have = lambda c: (F.col(c) if c in observations.columns else F.lit(None)).cast("string").alias(c)
    rows = observations.filter("notice_key is not null").select(
        "notice_key", "normalized_url", "content_hash", F.unix_micros("observed_at").alias("observed_at"), badged.alias("badged"), plain.alias("plain"), have("title"),
        have("publication_date"))
    known = None
    if initial is not None:
        known = initial.withColumns({c: F.unix_micros(c) for c in _TIMES[1:]}).groupBy("notice_key")
    out = rows.groupBy("notice_key").transformWithState(Heads(ttl_ms), CHANGE, "Append", "ProcessingTime" if ttl_ms else "None", known)
    return out.withColumns({c: F.timestamp_micros(c) for c in _TIMES})


def ingest_heads(
    observations: DataFrame, folder: str, checkpoint: str, initial: DataFrame | None = None, ttl_ms: int | None = None
) -> StreamingQuery:
    """Keep the tables ``changes`` and ``heads`` below ``folder``: a folder for each batch, which a batch that is run again replaces."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        put(batch, "changes")
        rest = [c for c in batch.columns if c not in ("notice_key", "normalized_url", "content_hash", "observed_at", "outcome", "seq")]
        put(batch.groupBy("notice_key").agg(F.max_by(F.struct(*rest), "seq").alias("h")).select("notice_key", "h.*"), "heads")
        batch.unpersist()

    with _rocks(observations.sparkSession):
        return changes(observations, initial, ttl_ms).writeStream.foreachBatch(run).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions_of(changes: DataFrame) -> DataFrame:
    """(notice_key, content_hash, observed_at): each content of a notice once, when it was first seen."""
    return changes.filter("outcome != 'DUPLICATE'").groupBy("notice_key", "content_hash").agg(F.min("observed_at").alias("observed_at"))


def initial_heads(classified: DataFrame) -> DataFrame:
    """The state after a table of classified observations, to begin a stream with."""
    badged, plain = without_badges(classified)
    have = lambda c: (F.col(c) if c in classified.columns else F.lit(None)).cast("string")
    live = classified.withColumns({"__b": badged, "__p": plain}).filter("outcome != 'DUPLICATE'")
    changed = F.when(F.col("outcome") != "UNCHANGED", F.col("observed_at"))
    new = F.when(F.col("outcome").isin("CREATED", "UPDATED"), F.col("observed_at"))
    at = lambda c: F.max_by(F.struct(c.alias("v")), changed)["v"]
    return live.groupBy("notice_key").agg(
        F.min_by("normalized_url", "observed_at").alias("own_url"), at(F.col("__p")).alias("plain"),
        F.max_by(F.struct(F.when(F.col("__b"), F.col("content_hash")).alias("v")), new)["v"].alias("badged_hash"),
        at(F.col("content_hash")).alias("current_content_hash"), at(have("title")).alias("title"), at(have("publication_date")).alias("publication_date"),
        F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"))
