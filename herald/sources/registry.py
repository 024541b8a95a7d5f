"""The source registry: upserts, configured views, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a seed sets; health columns are never touched by it (fixed values).
ATTRIBUTES = ("name", "source_type", "base_url", "listing_url", "official_domain", "is_official", "expected_marker", "provenance_note")
#: Bodies below so many bytes are suspect (a fixed value).
LEAST_BYTES = 500


def upsert_sources(stored: DataFrame, seed: DataFrame, now: Column, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """``stored`` after the seed: new rows inserted, rows of which an attribute differs updated with updated_at, others as they were."""
    s = seed.select(F.col("source_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in attributes])
    j = stored.join(s, stored["source_id"] == s["__id"], "full_outer")
    differs = F.lit(False)
    for c in attributes:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    new, change = F.col("source_id").isNull(), F.col("__id").isNotNull() & differs
    out = {c: F.when(F.col("__id").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in attributes}
    out |= {"source_id": F.coalesce("source_id", "__id"), "updated_at": F.when(new | change, now).otherwise(F.col("updated_at"))}
    if "created_at" in stored.columns:
        out["created_at"] = F.when(new, now).otherwise(F.col("created_at"))
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in stored.columns])


def insert_missing(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """``stored`` and the seed's rows whose source_id it lacks."""
    return stored.unionByName(seed.join(stored.select("source_id"), "source_id", "left_anti"), allowMissingColumns=True)


def configured(stored: DataFrame, config: DataFrame, columns: list[str]) -> DataFrame:
    """``stored`` with configured values over its own where there are any, by source_id."""
    c = config.select("source_id", *[F.col(x).alias(f"__{x}") for x in columns])
    j = stored.join(c, "source_id", "left")
    return j.select(*[F.coalesce(f"__{x}", x).alias(x) if x in columns else F.col(x) for x in stored.columns])


def health(status: Column, host_ok: Column, body_bytes: Column, marker_found: Column) -> Column:
    """HEALTHY, DEGRADED or FAILED of a fetch, by the first rule that fits; without a status the transport failed."""
    return (F.when(status.isNull(), "FAILED").when(status.isin(403, 429), "DEGRADED").when(status >= 400, "FAILED")
            .when(~F.coalesce(host_ok, F.lit(False)), "DEGRADED").when(F.coalesce(body_bytes, F.lit(0)) < LEAST_BYTES, "DEGRADED")
            .when(~F.coalesce(marker_found, F.lit(False)), "DEGRADED").otherwise("HEALTHY"))


def apply_health(checks: DataFrame) -> DataFrame:
    """(source_id, health_status, last_checked_at, last_success_at) after all checks (source_id, checked_at, check_id, health)."""
    return checks.groupBy("source_id").agg(
        F.max_by("health", F.struct("checked_at", "check_id")).alias("health_status"), F.max("checked_at").alias("last_checked_at"),
        F.max(F.when(F.col("health") == "HEALTHY", F.col("checked_at"))).alias("last_success_at"))


def health_snapshots(stored: DataFrame, checks: DataFrame) -> DataFrame:
    """The log of checks (source_id, checked_at, check_id, health) with the new ones appended; a check that comes again adds nothing."""
    key = ["source_id", "checked_at", "check_id"]
    return stored.unionByName(checks.select(*stored.columns).dropDuplicates(key).join(stored.select(*key), key, "left_anti"))
