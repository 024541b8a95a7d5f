"""Registered queries: feeds of customers as profiles and parts as obligations."""

from __future__ import annotations

from pyspark.sql import functions as F

from herald.operators import feed as I
from herald.plans.tables import table

_NOW = "2026-03-15 16:59:59"


def _profiles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("profile_id"), F.col("c_mktsegment").alias("faculty"), F.when(k % 4 != 0, F.lit("m0")).alias("major"),
        F.concat(F.lit("K"), (k % 3 + 20).cast("string")).alias("cohort"), F.lit(None).cast("string").alias("program")
    )


def _obligations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    none = F.expr("cast(array() as array<string>)")
    audience = F.struct(
        (k % 5 == 0).alias("applies_to_all_students"), F.when(
            k % 5 == 1, F.array(F.lit("FURNITURE"), F.lit("MACHINERY"))
        ).otherwise(none).alias("faculties"),
        F.when(k % 5 == 2, F.array(F.lit("m0"))).otherwise(none).alias("majors"), F.when(k % 5 <= 2, F.array(F.lit("K20"))).otherwise(none).alias("cohorts"), none.alias("programs"))
    day = lambda n, start: F.date_format(F.date_add(F.lit(start).cast("date"), (k % n).cast("int")), "yyyy-MM-dd")
    return p.select(
        k.alias("obligation_id"), audience.alias("audience"), F.when(
            k % 7 != 0, day(30, "2026-03-01")
        ).alias("deadline"), F.lit("date").alias("deadline_precision"),
        F.when(k % 3 == 0, day(40, "2026-02-20")).alias("start"), F.lit("date").alias("start_precision"), F.when(
            k % 11 == 0, F.concat(day(30, "2026-03-01"), F.lit("T08:00:00+07:00"))
        ).alias("end"), F.lit("datetime").alias("end_precision"),
        F.when(k % 2 == 0, k).alias("amount"), F.col("p_brand").alias("location"), F.when(k % 13 == 0, "SUPERSEDED_OUTDATED").otherwise("CURRENT").alias("validity"), F.col("p_type").alias("action_type"), F.col("p_name").alias("action_text"))


def _by_class(spark, sf_dir):
    return I.feed_by_class(_profiles(spark, sf_dir), _obligations(spark, sf_dir), F.lit(_NOW).cast("timestamp"))


def personal_feed(spark, sf_dir):
    """The feed of each class of profiles; ``feed_members`` has the classes of profiles."""
    f = _by_class(spark, sf_dir)
    return f.select(
        "faculty", "major", "cohort", "obligation_id", "applicability", "actionability", F.array_join("missing", ",").alias("missing"),
        F.col("position").cast("long").alias("position")
    )


def feed_members(spark, sf_dir):
    """Each profile with the dimensions of its class and the first item of its feed."""
    profiles = _profiles(spark, sf_dir)
    first = _by_class(spark, sf_dir).filter("position = 1")
    return I.for_profiles(profiles, first).join(profiles, "profile_id").select(
        "profile_id", "faculty", "major", "cohort", "obligation_id", "applicability"
    )


def feed_groups(spark, sf_dir):
    """Open items of each profile by applicability: counted for each class, then joined to the profiles."""
    dims = tuple(p for p, _ in I.DIMENSIONS)
    return I.for_profiles(_profiles(spark, sf_dir), I.visible_groups(_by_class(spark, sf_dir), dims))


def action_briefs(spark, sf_dir):
    """Briefs of the items that apply to a class."""
    items = _by_class(spark, sf_dir).filter("applicability = 'APPLIES'")
    b = I.action_brief(items, _obligations(spark, sf_dir))
    return b.select(
        "faculty", "major", "cohort", "obligation_id", "action_type", "action_text", "deadline", "amount", "location", "actionability",
        F.array_join("missing", ",").alias("missing")
    )


QUERIES = {f.__name__: f for f in (personal_feed, feed_members, feed_groups, action_briefs)}
_FEED = """
WITH p AS (SELECT c_custkey AS profile_id, c_mktsegment AS faculty, CASE WHEN c_custkey % 4 <> 0 THEN 'm0' END AS major, 'K' || (c_custkey % 3 + 20) AS cohort FROM customer),
c AS (SELECT DISTINCT faculty, major, cohort FROM p),
o AS (
  SELECT p_partkey AS id, p_partkey % 5 AS a, CASE WHEN p_partkey % 7 <> 0 THEN DATE '2026-03-01' + (p_partkey % 30)::INT END AS due,
         CASE WHEN p_partkey % 3 = 0 THEN (DATE '2026-02-20' + (p_partkey % 40)::INT)::TIMESTAMP - INTERVAL 7 HOUR END AS from_,
         CASE WHEN p_partkey % 11 = 0 THEN (DATE '2026-03-01' + (p_partkey % 30)::INT)::TIMESTAMP + INTERVAL 1 HOUR END AS end_, p_type, p_name, p_brand
  FROM part WHERE p_partkey % 13 <> 0),
t AS (
  SELECT *, coalesce(end_, (due + 1)::TIMESTAMP - INTERVAL 7 HOUR) AS until, TIMESTAMP '2026-03-15 16:59:59' AS now FROM o),
s AS (
  SELECT *, CASE WHEN from_ > until THEN 'UNKNOWN' WHEN now < from_ THEN 'UPCOMING' WHEN until IS NULL THEN 'NO_DEADLINE'
    WHEN CASE WHEN end_ IS NOT NULL THEN now > until ELSE now >= until END THEN 'EXPIRED' ELSE 'ACTIVE' END AS actionability,
    concat_ws(',', CASE WHEN due IS NULL THEN 'deadline' END, CASE WHEN id % 2 = 1 THEN 'amount' END) AS missing FROM t),
i AS (
  SELECT faculty, major, cohort, id AS obligation_id, actionability, missing, due, p_type, p_name, p_brand,
    CASE WHEN a = 0 THEN 'APPLIES' WHEN a > 2 THEN 'UNKNOWN' WHEN cohort <> 'K20' THEN 'DOES_NOT_APPLY'
         WHEN a = 1 AND faculty NOT IN ('FURNITURE', 'MACHINERY') THEN 'DOES_NOT_APPLY' WHEN a = 2 AND major IS NULL THEN 'UNKNOWN' ELSE 'APPLIES' END AS applicability
  FROM c, s),
f AS (SELECT *, row_number() OVER (PARTITION BY faculty, major, cohort ORDER BY applicability <> 'APPLIES', due IS NULL, obligation_id) AS position FROM i)
"""
SQL = {
    "personal_feed": _FEED + "SELECT faculty, major, cohort, obligation_id, applicability, actionability, missing, position FROM f",
    "feed_members": _FEED + "SELECT p.profile_id, p.faculty, p.major, p.cohort, obligation_id, applicability FROM p JOIN f ON p.faculty = f.faculty AND p.major IS NOT DISTINCT FROM f.major AND p.cohort = f.cohort WHERE position = 1",
    "feed_groups": _FEED + ", g AS (SELECT faculty, major, cohort, applicability, count(*) AS items FROM f WHERE actionability <> 'EXPIRED' GROUP BY ALL) SELECT profile_id, applicability, items FROM p JOIN g ON p.faculty = g.faculty AND p.major IS NOT DISTINCT FROM g.major AND p.cohort = g.cohort",
    "action_briefs": _FEED + "SELECT faculty, major, cohort, obligation_id, p_type AS action_type, p_name AS action_text, strftime(due, '%Y-%m-%d') AS deadline, CASE WHEN obligation_id % 2 = 0 THEN obligation_id END AS amount, p_brand AS location, actionability, missing FROM f WHERE applicability = 'APPLIES'",
}
