"""Notices from observations: identity, change classification, versions, heads, histories.

An observation is one fetch of a page: source_id, notice_key or canonical_url,
title, publication_date, raw_text, content_hash, observed_at and what else
there is. Everything derives from the observation table by keys, windows
within a key, and aggregates, so a rerun gives the same notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herald.functions.text import clean_text, clean_title
from herald.functions.urls import normalize_url, notice_id


def content_hash(title: Column, published: Column, text: Column, attachments: Column) -> Column:
    """SHA-256 of the JSON of cleaned title and text, ISO date and sorted attachments, keys in alphabetical order."""
    record = F.struct(
        F.array_sort(attachments).alias("attachments"), published.alias("publication_date"), clean_text(text).alias("raw_text"),
        clean_text(title).alias("title")
    )
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def resolve_identity(
    obs: DataFrame, domain: str, id_pattern: str = r"(?i)/id/(\d+)(?:/|$)", namespace: str = "notice",
    order: tuple[str, ...] = ("observed_at",), shared: Column | None = None
) -> DataFrame:
    """``obs`` with ``normalized_url`` and ``notice_key``, the normalized URL that the notice was first seen by.

    A URL that was seen before names its notice. A new one belongs to the
    notice whose own URL has the same official id, the first of these, if there
    is one; else it is a new notice. ``shared`` is the official id that an
    observation by a URL without one claims. URLs are summed up once each, so
    the observations are shuffled by URL only.
    """
    own = notice_id("canonical_url", domain, id_pattern, namespace)
    seen = obs.withColumn("normalized_url", normalize_url("canonical_url", domain))
    first = F.struct(*order, own.alias("own"), F.coalesce(own, shared if shared is not None else F.lit(None).cast("string")).alias("id"))
    urls = seen.groupBy("normalized_url").agg(F.min(first).alias("f")).select(
        "normalized_url", F.struct(*[F.col(f"f.{c}") for c in order], "normalized_url").alias("at"), "f.own", "f.id"
    )
    anchor = urls.filter("own is not null").groupBy("own").agg(F.min("at").alias("anchor")).withColumnRenamed("own", "__own")
    placed = urls.join(anchor, F.col("id") == F.col("__own"), "left")
    key = F.when(F.col("anchor") < F.col("at"), F.col("anchor.normalized_url")).otherwise(F.col("normalized_url"))
    return seen.join(
        placed.select("normalized_url", key.alias("notice_key")), "normalized_url"
    ).select(*obs.columns, "normalized_url", "notice_key")


def without_badges(obs: DataFrame) -> tuple[Column, Column]:
    """Whether an observation's title has badges, and the hash of its content without them."""
    if "title" not in obs.columns:
        return F.lit(False), F.col("content_hash")
    badged = ~clean_title("title").eqNullSafe(clean_text("title"))
    if "raw_text" not in obs.columns:
        return badged, F.col("content_hash")
    have = lambda c, kind: F.col(c) if c in obs.columns else F.lit(None).cast(kind)
    return badged, content_hash(clean_title("title"), have("publication_date", "string"), F.col("raw_text"), have("attachments", "array<string>"))


def classify_changes(
    obs: DataFrame, key: str = "notice_key", url: str = "normalized_url", order: tuple[str, ...] = ("observed_at",)
) -> DataFrame:
    """``obs`` with ``outcome``: CREATED, UPDATED, UNCHANGED or DUPLICATE.

    The first URL seen of a notice is its own. What comes by another URL of
    the same notice is a DUPLICATE whatever it holds. Others are compared with
    the notice's head: the same content is UNCHANGED, and so is one that only
    lacks the badges of the head's title; the head then keeps its title.

    As long as nothing but badges changes, the head is the last observation
    with badges, or the first one if none has any. So windows within such runs
    tell what a fold over the observations would.
    """
    by = Window.partitionBy(key).orderBy(*order)
    own = F.first(url).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = obs.withColumn("__dup", ~F.col(url).eqNullSafe(own))
    badged, plain = without_badges(obs)
    marked = marked.withColumns({"__badged": badged, "__plain": plain})
    line = Window.partitionBy(key, "__dup").orderBy(*order)
    marked = marked.withColumns(
        {
            "__n": F.row_number().over(line),
            "__same": F.col("__plain").eqNullSafe(F.lag("__plain").over(line)) & (F.row_number().over(line) > 1)
        }
    )
    marked = marked.withColumn(
        "__run", F.sum(F.when(F.col("__same"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    earlier = Window.partitionBy(key, "__dup", "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    head = F.last(F.when(F.col("__badged"), F.col("content_hash")), ignorenulls=True).over(earlier)
    kept = F.col("__same") & (~F.col("__badged") | head.eqNullSafe(F.col("content_hash")))
    outcome = F.when(F.col("__dup"), "DUPLICATE").when(F.col("__n") == 1, "CREATED").when(kept, "UNCHANGED").otherwise("UPDATED")
    return marked.withColumn("outcome", outcome).select(*obs.columns, "outcome")


def versions(classified: DataFrame, key: str = "notice_key") -> DataFrame:
    """(key, content_hash, observed_at): each content of a notice once, when it was first seen; duplicates add none."""
    return classified.filter("outcome != 'DUPLICATE'").groupBy(key, "content_hash").agg(F.min("observed_at").alias("observed_at"))


def heads(classified: DataFrame, key: str = "notice_key", order: tuple[str, ...] = ("observed_at",)) -> DataFrame:
    """(key, first_observed_at, last_observed_at, current_content_hash) after all observations but duplicates; with title and date where observations have them."""
    live = classified.filter("outcome != 'DUPLICATE'")
    changed = F.when(F.col("outcome") != "UNCHANGED", F.struct(*order))
    more = [F.max_by(F.struct(c), changed)[c].alias(c) for c in ("title", "publication_date") if c in classified.columns]
    return live.groupBy(key).agg(
        F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"),
        F.max_by("content_hash", changed).alias("current_content_hash"), *more
    )


def discoveries(obs: DataFrame, key: str = "notice_key") -> DataFrame:
    """Where a notice was found: first and last time, and the metadata of the last, per source and URL."""
    return obs.groupBy(key, "source_id", "normalized_url").agg(
        F.min("observed_at").alias("first_discovered_at"), F.max("observed_at").alias("last_discovered_at"),
        F.max_by("metadata", F.struct("observed_at", "metadata")).alias("metadata")
    )


def current_versions(version: DataFrame, head: DataFrame, key: str = "notice_key") -> DataFrame:
    """``version`` with ``is_latest``: the content that the head points to, also after a return to older content."""
    return version.join(head.select(key, "current_content_hash"), key).withColumn(
        "is_latest", F.col("content_hash") == F.col("current_content_hash")
    ).drop("current_content_hash")


def newest_versions(version: DataFrame, key: str = "notice_key", version_id: str = "version_id") -> DataFrame:
    """The version of greatest id of each notice; not the current one if content went back."""
    columns = [c for c in version.columns if c != key]
    return version.groupBy(key).agg(F.max(F.struct(version_id, *[c for c in columns if c != version_id])).alias("v")).select(key, "v.*")


def recent_notices(notices: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` latest by publication, undated ones last, then by id descending."""
    return notices.orderBy(F.col("publication_date").desc_nulls_last(), F.col("notice_id").desc()).limit(limit)


def version_history(version: DataFrame, key: str = "notice_key") -> DataFrame:
    """``version`` with its number from 1, the content before it, and ``has_history``."""
    w = Window.partitionBy(key).orderBy("observed_at", "content_hash")
    out = version.withColumns({"number": F.row_number().over(w), "previous_hash": F.lag("content_hash").over(w)})
    return out.withColumn("has_history", F.count("*").over(Window.partitionBy(key)) > 1)


def version_coverage(version: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: current and historical versions, and relations."""
    return version.agg(
        F.count_if("is_latest").alias("current"), F.count_if(~F.col("is_latest")).alias("historical")
    ).crossJoin(relations.agg(F.count("*").alias("relations")))


def notice_catalog(notices: DataFrame, sources: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Notices with their source's name and whether a reviewed annotation covers them."""
    has = reviewed.select("notice_id").distinct().withColumn("covered", F.lit(True))
    return notices.join(sources, "source_id").join(has, "notice_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def notice_detail(
    head: DataFrame, version: DataFrame, notice: Column, key: str = "notice_key", version_id: str = "version_id"
) -> DataFrame:
    """The head of one notice with its newest version; no row for an unknown notice. The filter reaches both scans."""
    one = F.col(key) == notice
    return head.filter(one).join(newest_versions(version.filter(one), key, version_id), key, "left")


def append_only(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``table`` and the rows of ``new`` whose key it lacks, one for each key."""
    return table.unionByName(new.dropDuplicates(key).join(table.select(*key), key, "left_anti"))
