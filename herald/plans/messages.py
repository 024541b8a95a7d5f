"""Registered queries: claims of messages and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herald.functions.text import parse_deadline, parse_vnd
from herald.operators import claims as C
from herald.operators import verify as V
from herald.plans.tables import messages_of_orders, notices_of_orders, table

_BASE = """
WITH n AS (
  SELECT o_orderkey AS id, o_orderkey % 5 AS way, CAST(o_orderdate AS DATE) + 30 AS due,
         (floor(o_totalprice / 1000)::BIGINT * 1000 + 100000) AS cost,
         CASE o_orderkey % 3 WHEN 0 THEN 'register' WHEN 1 THEN 'submit' ELSE 'pay' END AS kind FROM orders)
"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = C.extract_claims(messages_of_orders(spark, sf_dir)).withColumns(
        {"notice_id": F.col("message_id"), "version_id": F.lit(1).cast("long")}
    )
    official = notices_of_orders(spark, sf_dir)
    validity = official.select(
        "notice_id", "version_id", F.when(F.col("notice_id") % 11 == 0, "SUPERSEDED_OUTDATED").otherwise("CURRENT").alias("validity")
    )
    return V.verify_claims(claims, official.drop("due", "cost", "kind"), validity)


def verify_messages(spark, sf_dir):
    """All messages verified against the obligations of their notices: one verdict for each message."""
    return V.message_verdicts(_verdicts(spark, sf_dir))


def claim_verdicts(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return v.select(
        "message_id", F.col("claim_ix").cast("long").alias("claim_ix"), "verdict", "abstention_reason", "action_state", "deadline_state",
        "amount_state"
    )


def evidence_shown(spark, sf_dir):
    return V.evidence_shown(_verdicts(spark, sf_dir)).withColumn("claim_ix", F.col("claim_ix").cast("long"))


def verdict_distribution(spark, sf_dir):
    """Message verdicts counted, with every class present."""
    domain = spark.createDataFrame(
        [(v,) for v in ("VERIFIED", "PARTIALLY_VERIFIED", "CONFLICT", "INSUFFICIENT_EVIDENCE")], "verdict string"
    )
    counts = verify_messages(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counts, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))


def segment_claims(spark, sf_dir):
    return C.segment_claims(messages_of_orders(spark, sf_dir)).select(
        "message_id", F.col("claim_ix").cast("long").alias("claim_ix"), F.col("start_char").cast("long").alias("start_char"),
        F.col("end_char").cast("long").alias("end_char"), "text"
    )


def segment_conversations(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("message_id"), "text")
    return C.segment_claims(t).groupBy("message_id").agg(F.count("*").alias("claims"), F.sum(F.length("text")).alias("chars"))


def claim_fields(spark, sf_dir):
    c = C.extract_claims(messages_of_orders(spark, sf_dir)).filter("claim_ix = 0")
    return c.select(
        "message_id", F.col("action.type").alias("action"), F.col("action.text").alias("verb"), F.col("deadline.text").alias("deadline"),
        F.col("deadline.normalized").alias("deadline_norm"), F.col("amount.value").alias("amount"),
        F.col("audience.cohort").alias("cohort"), "object_hint"
    )


def parse_values(spark, sf_dir):
    """Deadlines and money read from text built of each order's columns."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(
        F.lit("Từ 01/02/2020 đến 17h30 ngày "), F.date_format("o_orderdate", "d-M-yyyy"),
        F.when(F.col("o_orderkey") % 4 == 0, " hoặc 31/02/2021").otherwise("")
    )
    money = F.when(F.col("o_orderkey") % 3 == 0, F.concat((F.col("o_orderkey") % 900).cast("string"), F.lit(" k"))).when(
        F.col("o_orderkey") % 3 == 1, F.concat((F.col("o_orderkey") % 50).cast("string"), F.lit(",5 triệu đồng"))
    ).otherwise(F.concat(F.lit("lệ phí "), (F.col("o_orderkey") % 900 + 100).cast("string"), F.lit(".000 VND")))
    d = parse_deadline(text)
    return o.select("o_orderkey", d["normalized"].alias("normalized"), d["precision"].alias("precision"), parse_vnd(money).alias("vnd"))


def temporal_validity(spark, sf_dir):
    """Versions by user and event type; all lineitems as relations, to a version or to all of a notice."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("notice_id"), "event_type").agg(
        F.min("event_id").alias("version_id"), F.max("event_id").alias("last")
    )
    top = e.groupBy("notice_id").agg(F.max("last").alias("m"))
    versions = e.join(top, "notice_id").select("notice_id", "version_id", (F.col("last") == F.col("m")).alias("is_latest"))
    li = table(spark, sf_dir, "lineitem")
    relation = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id"), (F.col("l_partkey") % 1000).alias("target_notice_id"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_orderkey")).alias("target_version_id"),
        F.when(F.col("l_returnflag") == "R", "supersedes").when(F.col("l_returnflag") == "A", "related").otherwise("amends").alias("relation_type"), F.when(F.col("l_linestatus") == "O", "Reviewed").otherwise("model").alias("provenance"))
    return V.temporal_validity(versions, relation)


QUERIES = {
    f.__name__: f for f in (
        verify_messages, claim_verdicts, evidence_shown, verdict_distribution, segment_claims, segment_conversations, claim_fields,
        parse_values, temporal_validity
    )
}

_CLAIMS = _BASE + """,
s AS (
  SELECT *, CASE WHEN way = 4 OR kind = 'X' THEN NULL ELSE 'MATCH' END AS a,
    CASE WHEN way = 4 THEN NULL WHEN way = 3 THEN 'INSUFFICIENT_EVIDENCE' WHEN way = 1 THEN 'CONFLICT' ELSE 'MATCH' END AS d,
    CASE WHEN way = 4 OR kind <> 'pay' THEN NULL WHEN way = 2 THEN 'CONFLICT' ELSE 'MATCH' END AS m FROM n),
v AS (
  SELECT *, CASE WHEN a IS NULL THEN 'ABSTAINED' WHEN d = 'CONFLICT' OR m = 'CONFLICT' THEN 'CONFLICT'
                 WHEN d = 'INSUFFICIENT_EVIDENCE' THEN 'PARTIALLY_VERIFIED' ELSE 'VERIFIED' END AS raw FROM s),
g AS (
  SELECT *, CASE WHEN id % 11 = 0 AND raw = 'VERIFIED' THEN 'PARTIALLY_VERIFIED' WHEN id % 11 = 0 AND raw = 'CONFLICT' THEN 'INSUFFICIENT_EVIDENCE' ELSE raw END AS verdict FROM v)
"""
#: The second block of messages of even keys is a claim without any supported field.
_MESSAGE = "CASE verdict WHEN 'CONFLICT' THEN 'CONFLICT' WHEN 'VERIFIED' THEN CASE WHEN id % 2 = 0 THEN 'PARTIALLY_VERIFIED' ELSE 'VERIFIED' END WHEN 'PARTIALLY_VERIFIED' THEN 'PARTIALLY_VERIFIED' ELSE 'INSUFFICIENT_EVIDENCE' END"
_TEXT = _BASE + """,
t AS (
  SELECT id, way, kind,
    CASE WHEN way = 4 THEN 'Kiểm tra kết quả' WHEN kind = 'register' THEN 'Sinh viên K21 đăng ký học phần' WHEN kind = 'submit' THEN 'Sinh viên nộp đơn xin xác nhận' ELSE 'Đóng học phí' END
    || CASE WHEN kind = 'pay' AND way <> 4 THEN ' ' || (cost + CASE WHEN way = 2 THEN 500000 ELSE 0 END) || ' đồng' ELSE '' END
    || ' trước ngày ' || CASE WHEN way = 1 THEN strftime(due + 4, '%d/%m/%Y') WHEN way = 3 THEN strftime(due, '%d/%m') ELSE strftime(due, '%d/%m/%Y') END AS a,
    'Thông báo số ' || id AS b, due, cost FROM n)
"""
SQL = {
    "verify_messages": _CLAIMS + f"SELECT id AS message_id, (2 - id % 2)::BIGINT AS n_claims, {_MESSAGE} AS verdict FROM g",
    "claim_verdicts": _CLAIMS + """
SELECT id AS message_id, 0::BIGINT AS claim_ix, verdict, CASE WHEN a IS NULL THEN 'NO_OFFICIAL_FIELD' END AS abstention_reason, a AS action_state, d AS deadline_state, m AS amount_state FROM g
UNION ALL SELECT id, 1, 'ABSTAINED', 'UNSUPPORTED_CLAIM_FIELD', NULL, NULL, NULL FROM g WHERE id % 2 = 0""",
    "evidence_shown": _CLAIMS + """
SELECT id AS message_id, 0::BIGINT AS claim_ix, CASE verdict WHEN 'ABSTAINED' THEN 'INSUFFICIENT_EVIDENCE' ELSE verdict END AS public_verdict, verdict <> 'ABSTAINED' AS evidence_visible, verdict = 'VERIFIED' AND id % 2 = 1 AS verified_primary FROM g
UNION ALL SELECT id, 1, 'INSUFFICIENT_EVIDENCE', false, false FROM g WHERE id % 2 = 0""",
    "verdict_distribution": _CLAIMS + f"""
, d(verdict) AS (VALUES ('VERIFIED'), ('PARTIALLY_VERIFIED'), ('CONFLICT'), ('INSUFFICIENT_EVIDENCE')),
k AS (SELECT {_MESSAGE} AS verdict, count(*) AS n FROM g GROUP BY 1)
SELECT verdict, coalesce(n, 0)::BIGINT AS n FROM d LEFT JOIN k USING (verdict)""",
    "segment_claims": _TEXT + """
SELECT id AS message_id, 0::BIGINT AS claim_ix, 0::BIGINT AS start_char, length(a)::BIGINT AS end_char, a AS text FROM t
UNION ALL SELECT id, 1, length(a) + 2, length(a) + 2 + length(b), b FROM t WHERE id % 2 = 0""",
    "segment_conversations": r"""
WITH m AS (SELECT conv_id || ':' || turn AS message_id, text, CASE WHEN contains(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) THEN [text] ELSE regexp_split_to_array(text, '\.\s+|[!?]+') END AS parts FROM conversations),
c AS (SELECT message_id, unnest(list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS c FROM m)
SELECT message_id, count(*) AS claims, sum(length(c))::BIGINT AS chars FROM c GROUP BY 1""",
    "claim_fields": _TEXT + """
SELECT id AS message_id, CASE WHEN way = 4 THEN 'check' ELSE kind END AS action,
  CASE WHEN way = 4 THEN 'Kiểm tra' WHEN kind = 'register' THEN 'đăng ký' WHEN kind = 'submit' THEN 'nộp' ELSE 'Đóng' END AS verb,
  CASE WHEN way = 1 THEN strftime(due + 4, '%d/%m/%Y') WHEN way = 3 THEN strftime(due, '%d/%m') ELSE strftime(due, '%d/%m/%Y') END AS deadline,
  CASE WHEN way = 1 THEN strftime(due + 4, '%Y-%m-%d') WHEN way = 3 THEN NULL ELSE strftime(due, '%Y-%m-%d') END AS deadline_norm,
  CASE WHEN kind = 'pay' AND way <> 4 THEN cost + CASE WHEN way = 2 THEN 500000 ELSE 0 END END AS amount,
  CASE WHEN way <> 4 AND kind = 'register' THEN 'K21' END AS cohort,
  CASE WHEN way = 4 THEN 'kết quả' WHEN kind = 'register' THEN 'học phần' WHEN kind = 'submit' THEN 'đơn xin xác nhận'
       ELSE 'học phí ' || (cost + CASE WHEN way = 2 THEN 500000 ELSE 0 END) || ' đồng' END AS object_hint FROM t""",
    "parse_values": """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT17:30:00+07:00') END AS normalized,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE 'datetime' END AS precision,
  CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 900) * 1000 WHEN 1 THEN (o_orderkey % 50) * 1000000 + 500000 ELSE (o_orderkey % 900 + 100) * 1000 END::BIGINT AS vnd FROM orders""",
    "temporal_validity": """
WITH e AS (SELECT user_id AS notice_id, event_type, min(event_id) AS version_id, max(event_id) AS last FROM events GROUP BY 1, 2),
v AS (SELECT notice_id, version_id, last = max(last) OVER (PARTITION BY notice_id) AS is_latest FROM e),
r AS (SELECT l_partkey % 1000 AS notice_id, CASE WHEN l_linenumber % 2 = 1 THEN l_orderkey END AS target, l_orderkey * 10 + l_linenumber AS relation_id, l_linestatus = 'O' AS confirmed FROM lineitem WHERE l_returnflag <> 'A'),
f AS (SELECT v.notice_id, v.version_id, arg_min(confirmed, (relation_id, confirmed)) AS confirmed FROM v JOIN r ON v.notice_id = r.notice_id AND (target IS NULL OR target = v.version_id) GROUP BY 1, 2)
SELECT v.notice_id, v.version_id, CASE WHEN NOT is_latest OR confirmed THEN 'SUPERSEDED_OUTDATED' WHEN f.notice_id IS NOT NULL THEN 'UNKNOWN' ELSE 'CURRENT' END AS validity
FROM v LEFT JOIN f ON v.notice_id = f.notice_id AND v.version_id = f.version_id""",
}
