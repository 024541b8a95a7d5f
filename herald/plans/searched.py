"""Registered queries: messages verified by evidence that a search of current notice versions finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from herald.operators import retrieval as R
from herald.operators import searched
from herald.operators import verify as V
from herald.plans.tables import table
from herald.sources.scratch import written

_KINDS = ("register", "submit", "pay")
_VERBS = ("Sinh viên đăng ký học phần", "Sinh viên nộp đơn xin xác nhận", "Sinh viên đóng học phí")


def _of(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def _notices(spark, sf_dir):
    """A notice for each vector, about the order of its id; every fourth has an old version with the same vector."""
    v = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "orders"), F.col("vec_id") == F.col("o_orderkey"))
    k = F.col("vec_id")
    due = F.date_add(F.col("o_orderdate").cast("date"), 30)
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    version = F.explode(F.when(k % 4 == 0, F.array(one, two)).otherwise(F.array(two))).alias("version_id")
    rows = v.select(
        k.alias("notice_id"), (F.floor(k / 50) % 8).alias("way"), due.alias("due"), R.normalise("embedding").alias("embedding"), version
    )
    on = F.date_add("due", F.when(F.col("version_id") == 1, -7).otherwise(0))
    text = F.concat(
        F.lit("Thông báo số "), F.col("notice_id").cast("string"), F.lit(": "), _of(_VERBS, F.col("notice_id") % 3), F.lit(" trước ngày "),
        F.date_format(on, "dd/MM/yyyy")
    )
    return rows.select(
        "notice_id", "version_id", "way", "due", "embedding", (F.col("notice_id") * 10 + F.col("version_id")).alias("chunk_id"),
        (F.col("version_id") == 2).alias("is_latest"), text.alias("text"), on.alias("on")
    )


def _obligations(notices):
    """Reviewed obligations of the versions; none for way 2, two for way 3."""
    n = notices.filter("way != 2").select(
        "notice_id", "version_id", "on",
        F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("ordinal")
    )
    day = F.date_add("on", F.col("ordinal"))
    return n.select(
        "notice_id", "version_id", "ordinal", _of(_KINDS, F.col("notice_id") % 3).alias("off_action"),
        F.date_format(day, "dd/MM/yyyy").alias("off_deadline"), F.date_format(day, "yyyy-MM-dd").alias("off_deadline_norm"),
        F.lit(None).cast("long").alias("off_amount")
    )


def _messages(notices, step):
    """A message for each notice whose id ``step`` divides, by (id / 50) modulo 8: as it is, another day, no reviewed obligation,
    two of them, a second claim without fields, no evidence, an amended notice, another action."""
    n = notices.filter((F.col("notice_id") % step == 0) & (F.col("version_id") == 2))
    way, number = F.col("way"), F.col("notice_id").cast("string")
    day = F.date_format(F.date_add("due", F.when(way == 1, 4).when(way == 3, 50).otherwise(0)), "dd/MM/yyyy")
    kind = (F.col("notice_id") + F.when(way == 7, 1).otherwise(0)) % 3
    text = F.concat(_of(_VERBS, kind), F.lit(" trước ngày "), day, F.lit(" theo thông báo số "), number)
    text = F.when(way == 5, F.concat(F.lit("Tham gia zz"), number)).when(way == 4, F.concat(text, F.lit("\n\nXin chào"))).otherwise(text)
    return n.select(F.col("notice_id").alias("message_id"), text.alias("text"), F.when(way != 5, F.col("embedding")).alias("vector"))


def _indexed(spark, sf_dir):
    """The notices, and their chunks indexed with obligations and validity."""
    n = written(_notices(spark, sf_dir), "notices")
    relations = n.filter("way = 6 and version_id = 2").select(
        F.col("notice_id").alias("relation_id"), F.col("notice_id").alias("target_notice_id"),
        F.lit(None).cast("long").alias("target_version_id"), F.lit("amends").alias("relation_type"), F.lit("manual").alias("provenance")
    )
    validity = V.temporal_validity(n.select("notice_id", "version_id", "is_latest"), relations)
    return n, searched.index_chunks(n, _obligations(n), validity)


def _judged(spark, sf_dir, step=50):
    n, evidence = _indexed(spark, sf_dir)
    return searched.verdicts(_messages(n, step), evidence)


def searched_evidence(spark, sf_dir):
    """The version that each claim is held against."""
    n, evidence = _indexed(spark, sf_dir)
    return searched.find(_messages(n, 50), evidence)[1].withColumn("claim_ix", F.col("claim_ix").cast("long"))


def searched_verdicts(spark, sf_dir):
    """Verdicts of the claims of messages by searched evidence, with all reasons to abstain among them."""
    return _judged(spark, sf_dir).select(
        "message_id", F.col("claim_ix").cast("long").alias("claim_ix"), "notice_id", "verdict", "abstention_reason", "deadline_state"
    )


def searched_messages(spark, sf_dir):
    """One verdict for each message by searched evidence."""
    return V.message_verdicts(_judged(spark, sf_dir))


def searched_every_notice(spark, sf_dir):
    """The same with a message about every notice."""
    return V.message_verdicts(_judged(spark, sf_dir, 1))


QUERIES = {f.__name__: f for f in (searched_evidence, searched_verdicts, searched_messages, searched_every_notice)}

_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}_]+'), lambda x: x <> '')"
_VERB = "CASE {} % 3 WHEN 0 THEN 'Sinh viên đăng ký học phần' WHEN 1 THEN 'Sinh viên nộp đơn xin xác nhận' ELSE 'Sinh viên đóng học phí' END"
_SEARCH = f"""
WITH b AS (
  SELECT vec_id AS v, vec_id // 50 % 8 AS way, o_orderdate::DATE + 30 AS due, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e
  FROM embeddings JOIN orders ON vec_id = o_orderkey),
n AS (SELECT *, 2 AS version FROM b UNION ALL SELECT *, 1 FROM b WHERE v % 4 = 0),
c AS (
  SELECT v, version, way, due, e, v * 10 + version AS id, due - CASE version WHEN 1 THEN 7 ELSE 0 END AS day,
         'Thông báo số ' || v || ': ' || {_VERB.format('v')} || ' trước ngày ' || strftime(due - CASE version WHEN 1 THEN 7 ELSE 0 END, '%d/%m/%Y') AS text FROM n),
m AS (
  SELECT v, way, due + CASE way WHEN 1 THEN 4 WHEN 3 THEN 50 ELSE 0 END AS day, (v + CASE way WHEN 7 THEN 1 ELSE 0 END) % 3 AS kind, CASE WHEN way <> 5 THEN e END AS e FROM b WHERE v % 50 = 0),
q AS (
  SELECT v * 10 AS query_id, v, way, CASE WHEN way <> 5 THEN day END AS day, CASE WHEN way <> 5 THEN kind END AS kind, e,
         CASE WHEN way = 5 THEN 'Tham gia zz' || v ELSE {_VERB.format('kind')} || ' trước ngày ' || strftime(day, '%d/%m/%Y') || ' theo thông báo số ' || v END AS text FROM m),
ct AS (SELECT id, {_TOK} AS t FROM c), cp AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM ct), tf AS (SELECT id, dl, term, count(*) AS tf FROM cp GROUP BY ALL),
cn AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ct), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qp AS (SELECT query_id, unnest({_TOK}) AS term FROM q), qf AS (SELECT query_id, term, count(*) AS qf FROM qp GROUP BY ALL),
w AS (SELECT query_id, term, qf * ln((n + 1) / df) AS w, avgdl FROM qf JOIN df USING (term), cn),
ev AS (SELECT query_id, sum(w) AS every FROM w GROUP BY 1),
sc AS (SELECT query_id, id, sum(w * tf * 2.5::DOUBLE / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl) + tf)) AS s FROM tf JOIN w USING (term) GROUP BY 1, 2),
bs AS (SELECT query_id, id, round(coalesce(s, 0) + every, 6) AS score FROM ev JOIN c ON true LEFT JOIN sc USING (query_id, id)),
br AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs WHERE score > 0),
dr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(c.e, q.e), 9) DESC, id) AS rank FROM q, c WHERE q.e IS NOT NULL),
u AS (SELECT query_id, id, rank, 0 AS list FROM br UNION ALL SELECT query_id, id, rank, 1 FROM dr),
f AS (SELECT query_id, u.id, sum(1.0 / (60 + rank)) AS score, min(list * 1000000 + rank) AS first FROM u JOIN c ON c.id = u.id WHERE version = 2 GROUP BY 1, 2),
t AS (SELECT query_id, id // 10 AS notice_id, id % 10 AS version_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, id) = 1)
"""
_JUDGE = _SEARCH + """,
o AS (SELECT v, version, k AS ordinal, v % 3 AS kind, day + k AS day FROM c, (VALUES (0), (1)) t(k) WHERE way <> 2 AND (k = 0 OR way = 3)),
p AS (
  SELECT q.query_id, q.v AS message_id, q.way, t.notice_id, o.ordinal, q.kind = o.kind AS a, CASE WHEN q.kind = o.kind AND q.day IS NOT NULL THEN q.day = o.day END AS d, o.day AS off_day
  FROM q LEFT JOIN t USING (query_id) LEFT JOIN o ON o.v = t.notice_id AND o.version = t.version_id),
g AS (
  SELECT query_id, message_id, any_value(notice_id) AS notice_id, count(ordinal) AS n, coalesce(bool_or(a), false) AS usable, arg_min(d, (NOT coalesce(d, false), ordinal)) FILTER (WHERE a) AS d,
         max(coalesce(d, false)::INT) FILTER (WHERE a) AS top FROM p GROUP BY 1, 2),
x AS (SELECT p.query_id, count(DISTINCT off_day) > 1 AS ambiguous FROM p JOIN g USING (query_id) WHERE a AND coalesce(p.d, false)::INT = top AND p.d IS NOT NULL GROUP BY 1),
r AS (
  SELECT g.*, CASE WHEN g.notice_id IS NULL THEN 'NO_RETRIEVAL_EVIDENCE' WHEN NOT usable THEN 'NO_OFFICIAL_FIELD' WHEN coalesce(ambiguous, false) THEN 'AMBIGUOUS_OFFICIAL_EVIDENCE' END AS why,
         g.notice_id // 50 % 8 = 6 AS old FROM g LEFT JOIN x USING (query_id)),
s AS (
  SELECT message_id, 0::BIGINT AS claim_ix, notice_id,
    CASE WHEN why IS NOT NULL THEN 'ABSTAINED' WHEN d THEN CASE WHEN old THEN 'PARTIALLY_VERIFIED' ELSE 'VERIFIED' END ELSE CASE WHEN old THEN 'INSUFFICIENT_EVIDENCE' ELSE 'CONFLICT' END END AS verdict,
    why AS abstention_reason, CASE WHEN why IS NULL THEN CASE WHEN d THEN 'MATCH' ELSE 'CONFLICT' END END AS deadline_state FROM r
  UNION ALL SELECT v, 1, NULL, 'ABSTAINED', 'UNSUPPORTED_CLAIM_FIELD', NULL FROM q WHERE way = 4)
"""
SQL = {
    "searched_evidence": _SEARCH + "SELECT query_id // 10 AS message_id, 0::BIGINT AS claim_ix, notice_id, version_id FROM t",
    "searched_verdicts": _JUDGE + "SELECT * FROM s",
    "searched_messages": _JUDGE + """
SELECT message_id, count(*) AS n_claims, CASE WHEN bool_or(verdict = 'CONFLICT') THEN 'CONFLICT' WHEN bool_and(verdict = 'VERIFIED') THEN 'VERIFIED'
  WHEN bool_or(verdict IN ('VERIFIED', 'PARTIALLY_VERIFIED')) THEN 'PARTIALLY_VERIFIED' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict FROM s GROUP BY 1""",
}
SQL["searched_every_notice"] = SQL["searched_messages"].replace("WHERE v % 50 = 0", "")
