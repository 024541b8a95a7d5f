"""Registered queries: URLs, identity, versions, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from herald.functions.urls import admission, host, normalize_url, official_host, source_of
from herald.operators import monitoring as M
from herald.operators import versions as N
from herald.plans.tables import checks, observations, table

_PREFIXES = [("/en/", "english"), ("/de/", "german"), ("/fr/", "french")]


def url_identity(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id", normalize_url("url", "example.org").alias("normalized"), host("url").alias("host"),
        official_host("url", "example.org").alias("official"), source_of("url", F.lit("other"), _PREFIXES).alias("owner"),
        F.coalesce(admission("url"), F.lit("OK")).alias("admission")
    )


def _classified(spark, sf_dir):
    return N.classify_changes(observations(spark, sf_dir), order=("observed_at", "event_id"))


def change_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("event_id", "notice_key", "outcome")


def crawl_stats(spark, sf_dir):
    c = _classified(spark, sf_dir)
    return c.groupBy("source_id").agg(
        F.count("*").alias("fetched"),
        *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("CREATED", "UPDATED", "UNCHANGED", "DUPLICATE")]
    )


def version_append(spark, sf_dir):
    return N.versions(_classified(spark, sf_dir))


def notice_heads(spark, sf_dir):
    return N.heads(_classified(spark, sf_dir), order=("observed_at", "event_id"))


def current_versions(spark, sf_dir):
    c = _classified(spark, sf_dir)
    return N.current_versions(
        N.versions(c), N.heads(c, order=("observed_at", "event_id"))
    ).select("notice_key", "content_hash", "is_latest")


def newest_versions(spark, sf_dir):
    """The version first seen last: other than the current one where content went back."""
    return N.newest_versions(N.versions(_classified(spark, sf_dir)), version_id="observed_at").select("notice_key", "content_hash")


def version_history(spark, sf_dir):
    return N.version_history(N.versions(_classified(spark, sf_dir))).select(
        "notice_key", "content_hash", F.col("number").cast("long").alias("number"), "previous_hash", "has_history"
    )


def discovery_upsert(spark, sf_dir):
    return N.discoveries(observations(spark, sf_dir))


def recent_notices(spark, sf_dir):
    """The 20 latest orders, those pending undated: a top-k report."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("notice_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("publication_date")
    )
    return N.recent_notices(o, 20).select("notice_id", F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"))


def document_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.sha2("text", 256).alias("raw_hash"),
        N.content_hash(F.col("source"), F.col("lang"), F.col("text"), F.array("lang", "source")).alias("content_hash")
    ).select("doc_id", "raw_hash", F.length("content_hash").cast("long").alias("hash_chars"))


def raw_store(spark, sf_dir):
    """Distinct payloads with how often each came."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("raw_hash")).agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc")
    )


def failure_streaks(spark, sf_dir):
    r = M.failure_streaks(checks(spark, sf_dir))
    return r.select(
        "check_id", F.col("consecutive_failures").cast("long").alias("consecutive_failures"), "delay_seconds", "last_changed_at"
    )


def source_state(spark, sf_dir):
    r = M.source_state(checks(spark, sf_dir))
    return r.select(
        "source_id", "check_id", F.col("consecutive_failures").cast("long").alias("consecutive_failures"), "delay_seconds", "last_error",
        "last_changed_at"
    )


def latest_activity(spark, sf_dir):
    """The latest event of each user at the time of the last one of all."""
    e = table(spark, sf_dir, "events")
    events = e.select(
        F.col("user_id").alias("notice_id"), "event_id", F.col("event_type").alias("outcome"), F.col("ts").alias("observed_at")
    )
    return M.latest_activity(events, e.agg(F.max("ts")).scalar()).select("notice_id", "event_id", "outcome")


def cycle_summary(spark, sf_dir):
    return M.cycle_summary(checks(spark, sf_dir))


def monitor_status(spark, sf_dir):
    s = M.source_state(checks(spark, sf_dir)).withColumn("last_outcome", F.col("outcome"))
    return M.monitor_status(s)


def source_outcomes(spark, sf_dir):
    c = checks(spark, sf_dir).groupBy("source_id").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("NEW", "UPDATED", "FAILED", "UNCHANGED")]
    )
    some = lambda n, left, count: F.when(F.col("source_id") % n == left, F.col(count)).otherwise(0)
    return c.select(
        "source_id",
        M.source_outcome(
            some(5, 0, "NEW"), some(3, 1, "UPDATED"), F.col("FAILED"), some(2, 0, "UNCHANGED"), some(7, 0, "UNCHANGED")
        ).alias("outcome")
    )


def snapshot_diff(spark, sf_dir):
    """Customers' balances against those raised for every third and missing for every fifth before."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("notice_id"), F.sha2(F.col("c_name"), 256).alias("content_hash"))
    before = c.filter("notice_id % 5 != 0").withColumn(
        "content_hash", F.when(F.col("notice_id") % 3 == 0, F.lit("old")).otherwise(F.col("content_hash"))
    )
    return M.snapshot_diff(before, c)


def skip_unmodified(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("etag"))
    seen = p.filter("page_id % 2 = 0").select("url", "etag")
    return M.skip_unmodified(p, seen, ["etag"]).select("page_id")


QUERIES = {
    f.__name__: f for f in (
        url_identity, change_classify, crawl_stats, version_append, notice_heads, current_versions, newest_versions, version_history,
        discovery_upsert, recent_notices, document_hashes, raw_store, failure_streaks, source_state, latest_activity, cycle_summary,
        monitor_status, source_outcomes, snapshot_diff, skip_unmodified
    )
}

_OBS = """
WITH o AS (
  SELECT event_id, user_id AS notice_key, user_id % 7 AS source_id, 'https://notices.example/id/' || user_id || CASE WHEN event_type = 'click' THEN '/mirror' ELSE '' END AS url,
         sha256(event_type) AS h, ts, props FROM events),
d AS (SELECT *, url IS DISTINCT FROM first_value(url) OVER (PARTITION BY notice_key ORDER BY ts, event_id) AS dup FROM o),
c AS (
  SELECT *, CASE WHEN dup THEN 'DUPLICATE' WHEN row_number() OVER w = 1 THEN 'CREATED' WHEN lag(h) OVER w = h THEN 'UNCHANGED' ELSE 'UPDATED' END AS outcome
  FROM d WINDOW w AS (PARTITION BY notice_key, dup ORDER BY ts, event_id)),
v AS (SELECT notice_key, h, min(ts) AS seen FROM c WHERE outcome <> 'DUPLICATE' GROUP BY 1, 2),
k AS (SELECT notice_key, min(ts) AS a, max(ts) AS b, arg_max(h, (ts, event_id)) FILTER (WHERE outcome <> 'UNCHANGED') AS h FROM c WHERE outcome <> 'DUPLICATE' GROUP BY 1)
"""
_RUNS = """
WITH r AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n,
             max(CASE WHEN event_type IN ('signup', 'purchase') THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last FROM r)
"""
_NORMAL = r"""
regexp_replace(regexp_replace(regexp_replace(url, '^http:(//[^/]*example\.org)', 'https:\1'), '(#.*)$', ''), '\?.*$', '')"""
SQL = {
    "url_identity": rf"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
q AS (SELECT *, coalesce(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|ref|source)(=|$)'))), '&'), '') AS kept FROM p)
SELECT page_id, CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'https' ELSE split_part(url, ':', 1) END || '://' || host
    || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS normalized,
  host, host = 'example.org' OR ends_with(host, '.example.org') AS official,
  CASE WHEN starts_with(path, '/en/') THEN 'english' WHEN starts_with(path, '/de/') THEN 'german' WHEN starts_with(path, '/fr/') THEN 'french' ELSE 'other' END AS owner, 'OK' AS admission FROM q""",
    "change_classify": _OBS + "SELECT event_id, notice_key, outcome FROM c",
    "crawl_stats": _OBS + "SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE outcome = 'CREATED') AS created, count(*) FILTER (WHERE outcome = 'UPDATED') AS updated, count(*) FILTER (WHERE outcome = 'UNCHANGED') AS unchanged, count(*) FILTER (WHERE outcome = 'DUPLICATE') AS duplicate FROM c GROUP BY 1",
    "version_append": _OBS + "SELECT notice_key, h AS content_hash, seen AS observed_at FROM v",
    "notice_heads": _OBS + "SELECT notice_key, a AS first_observed_at, b AS last_observed_at, h AS current_content_hash FROM k",
    "current_versions": _OBS + "SELECT v.notice_key, v.h AS content_hash, v.h = k.h AS is_latest FROM v JOIN k USING (notice_key)",
    "newest_versions": _OBS + "SELECT notice_key, arg_max(h, seen) AS content_hash FROM v GROUP BY 1",
    "version_history": _OBS + "SELECT notice_key, h AS content_hash, row_number() OVER w AS number, lag(h) OVER w AS previous_hash, count(*) OVER (PARTITION BY notice_key) > 1 AS has_history FROM v WINDOW w AS (PARTITION BY notice_key ORDER BY seen, h)",
    "discovery_upsert": _OBS + "SELECT notice_key, source_id, url AS normalized_url, min(ts) AS first_discovered_at, max(ts) AS last_discovered_at, arg_max(props, (ts, props)) AS metadata FROM o GROUP BY 1, 2, 3",
    "recent_notices": "SELECT o_orderkey AS notice_id, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS publication_date FROM orders ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END DESC NULLS LAST, o_orderkey DESC LIMIT 20",
    "document_hashes": "SELECT doc_id, sha256(text) AS raw_hash, 64::BIGINT AS hash_chars FROM documents",
    "raw_store": "SELECT sha256(text) AS raw_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "failure_streaks": _RUNS + "SELECT event_id AS check_id, n::BIGINT AS consecutive_failures, (600 * power(2, least(n, 4)))::BIGINT AS delay_seconds, changed AS last_changed_at FROM s",
    "source_state": _RUNS + "SELECT user_id AS source_id, event_id AS check_id, n::BIGINT AS consecutive_failures, (600 * power(2, least(n, 4)))::BIGINT AS delay_seconds, CASE WHEN event_type = 'error' THEN props END AS last_error, changed AS last_changed_at FROM s WHERE last = 1",
    "latest_activity": "WITH l AS (SELECT user_id AS notice_id, max(event_id) AS event_id FROM events GROUP BY 1) SELECT l.notice_id, l.event_id, e.event_type AS outcome FROM l JOIN events e USING (event_id) WHERE e.ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR",
    "cycle_summary": "SELECT time_bucket(INTERVAL '10 minutes', ts) AS started_at, count(*) FILTER (WHERE event_type = 'signup') AS new_count, count(*) FILTER (WHERE event_type = 'purchase') AS updated_count, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS unchanged_count, count(*) FILTER (WHERE event_type = 'error') AS failed_count FROM events GROUP BY 1",
    "monitor_status": _RUNS + "SELECT count(*) AS sources, count(*) FILTER (WHERE event_type <> 'error') AS healthy, max(changed) AS last_changed_at FROM s WHERE last = 1",
    "source_outcomes": """
WITH c AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'signup') AS n, count(*) FILTER (WHERE event_type = 'purchase') AS u, count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS s FROM events GROUP BY 1)
SELECT id AS source_id, CASE WHEN id % 5 = 0 AND n > 0 THEN 'NEW' WHEN id % 3 = 1 AND u > 0 THEN 'UPDATED' WHEN f > 0 AND NOT ((id % 2 = 0 OR id % 7 = 0) AND s > 0) THEN 'FAILED' ELSE 'UNCHANGED' END AS outcome FROM c""",
    "snapshot_diff": "SELECT c_custkey AS notice_id, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE 'UPDATED' END AS outcome FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0",
    "skip_unmodified": "SELECT page_id FROM pages WHERE page_id % 2 = 1",
}
