"""Registered queries: the remaining catalog, curation and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from herald.functions.text import fold_vietnamese, norm_text
from herald.operators import annotations as G
from herald.operators import evaluate as J
from herald.operators import monitoring as M
from herald.operators import obligations as O
from herald.operators import retrieval as R
from herald.operators import verify as V
from herald.operators import versions as N
from herald.plans.notices import _OBS, _classified
from herald.plans.tables import notices_of_orders, table


_ANCHORED = (
    ("register", "đăng kí"), ("apply", "nộp  đơn"), ("submit", "gửi hồ sơ"), ("pay", "đóng học phí"), ("attend", "tham gia"),
    ("collect", "nhận"), ("update", "tự đánh giá"), ("check", "xem"), ("other", "hoàn tất")
)


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def search_index(spark, sf_dir):
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    notices = o.select(F.col("o_orderkey").alias("notice_id"), (F.col("o_custkey") % 100).alias("source_id"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))
    newest = N.newest_versions(
        table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("notice_key"), F.col("l_linenumber").alias("version_id"), F.col("l_returnflag").alias("raw_text")
        ).dropDuplicates(["notice_key", "version_id"]).groupBy("notice_key", "version_id").agg(F.max("raw_text").alias("raw_text"))
    )
    activity = e.groupBy(F.col("user_id").alias("notice_id")).agg(F.max_by("event_type", "event_id").alias("outcome"))
    return R.search_index(
        notices, sources, newest.withColumnRenamed("notice_key", "notice_id"), activity
    ).select("notice_id", "category", F.col("text").isNotNull().alias("has_text"), "recent")


def notice_catalog(spark, sf_dir):
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("notice_id"), F.col("c_nationkey").alias("source_id"))
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source_name"))
    r = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("notice_id"))
    return N.notice_catalog(n, s, r).select("notice_id", "source_name", "covered")


def version_coverage(spark, sf_dir):
    c = _classified(spark, sf_dir)
    v = N.current_versions(N.versions(c), N.heads(c, order=("observed_at", "event_id")))
    return N.version_coverage(v, table(spark, sf_dir, "nation"))


def backfill_events(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    notices = o.select(
        F.col("o_orderkey").alias("notice_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("last_observed_at")
    )
    state = o.groupBy(F.col("o_custkey").alias("source_id")).agg(F.max("o_orderdate").alias("last_changed_at"))
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("notice_id")).agg(F.count("*").alias("version_count"))
    events = notices.filter("notice_id % 2 = 0").select(
        "notice_id", F.lit("UPDATED").alias("outcome"), F.col("last_observed_at").alias("observed_at")
    )
    return M.backfill_events(state, notices, counts, events).select("notice_id", "outcome", _day("observed_at").alias("day"))


def derived_queries(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("obligation_id"), F.col("p_name").alias("action_text"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("audience_text"), F.lit(None).cast("string").alias("deadline_text"),
        F.col("p_type").alias("document_text")
    )
    return J.derive_queries(p)


def candidate_claims(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("obligation_id"), _day("o_orderdate").alias("deadline"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("amount"), F.lit(None).cast("string").alias("audience"),
        F.col("o_orderpriority").alias("location"), F.lit(None).cast("string").alias("document")
    )
    return J.candidate_claims(o).select("obligation_id", "mutation", "deadline", "amount", "location")


def forced_pairs(spark, sf_dir):
    """Claims held against obligations of another kind than theirs, of which none may conflict, and every fourth against its own kind."""
    n = notices_of_orders(spark, sf_dir)
    claim = n.select(
        F.col("notice_id").alias("case_id"), ((F.col("notice_id") + F.when(F.col("notice_id") % 4 == 0, 0).otherwise(1)) % 3).alias("k"),
        F.lit("31/12/1990").alias("deadline_text"), F.lit("1990-12-31").alias("deadline_norm"), F.lit("1").alias("amount_text"),
        F.lit(1).cast("long").alias("amount_value"), "off_action", "off_deadline", "off_deadline_norm", "off_amount"
    )
    other = F.element_at(F.array(F.lit("register"), F.lit("submit"), F.lit("pay")), (F.col("k") + 1).cast("int"))
    e = V.evaluate(claim.withColumns({"action_type": other, "action_text": other}))
    return e.select(
        "case_id", V.field_verdict([F.col(f"{f}_state") for f in ("action", "deadline", "amount")]).alias("verdict"),
        F.col("comparable_count").cast("long").alias("compared"), "amount_state"
    )


def repaired_metadata(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("notice_id"), F.col("o_orderkey").alias("annotation"), F.lit("?").alias("title")
    )
    c = table(spark, sf_dir, "customer").filter("c_custkey % 4 != 0").select(
        F.col("c_custkey").alias("notice_id"), F.col("c_name").alias("title")
    )
    return G.repair_metadata(o, c, ["title"]).select("annotation", "title")


def decided_spans(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    records = o.select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("span"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus"))).alias("raw_text")
    )
    decision = F.element_at(F.array(F.lit("accept"), F.lit("edit"), F.lit("reject")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return G.apply_decisions(
        records,
        o.filter("o_orderkey % 7 != 0").select(
            F.col("o_orderkey").alias("record_id"), decision.alias("decision"), F.col("o_orderpriority").alias("new_span")
        )
    )


def annotation_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("notice_id"), F.col("o_orderkey").alias("stamp"), F.col("o_orderstatus").alias("annotation_status")
    )
    return G.upsert(o.filter("stamp % 2 = 0"), o.filter("stamp % 2 = 1"), ["notice_id"], "stamp")


def incomplete_annotations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("notice_id"),
        F.when(F.col("o_orderstatus") == "F", "GOLD").when(
            F.col("o_orderstatus") == "O", "REVIEWED"
        ).otherwise("DRAFT").alias("annotation_status"),
        F.when(F.col("o_custkey") % 3 != 0, "x").alias("annotator_id"), F.left("o_orderpriority", F.lit(3)).alias("quote"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("none").alias("raw_text")
    )
    return G.completeness(o)


def case_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cases = d.select(
        (F.col("doc_id") - F.when(F.col("doc_id") % 100 == 1, 1).otherwise(0)).alias("case_id"), "text",
        F.when(F.col("doc_id") % 10 == 0, "\u0001").otherwise("").alias("span"),
        F.when(F.col("doc_id") % 9 == 0, "fly").otherwise("pay").alias("action"), F.lit(1).alias("claim_count"),
        (F.col("doc_id") % 2).alias("claims")
    )
    return G.case_violations(cases, table(spark, sf_dir, "benchmark").select("text"), ("pay",)).groupBy("rule").agg(F.count("*").alias("n"))


def catalog_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    program = F.struct(
        F.col("n_name").alias("display_name"), F.array(F.lower("n_name"), F.lit("x")).alias("aliases"),
        (F.col("n_nationkey") % 20).cast("string").alias("official_code"), F.lit("verified").alias("faculty_assignment_status")
    )
    f = table(spark, sf_dir, "region").join(
        n.groupBy("n_regionkey").agg(F.collect_list(program).alias("programs")), F.col("r_regionkey") == F.col("n_regionkey")
    ).select(F.col("r_regionkey").alias("faculty_id"), F.col("r_name").alias("display_name"), "programs")
    flat = G.flatten_catalog(f)
    used = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("source_ref")).distinct()
    return G.catalog_violations(flat, used, used.filter("source_ref != 'BUILDING'"))


def expected_values(spark, sf_dir):
    """Scores by field of values of each order: one that its lines may name, one that nobody expects, one that is named twice."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    want = F.array(
        F.struct(F.lit("a").alias("field"), F.when(k % 3 != 0, F.concat(F.lit("v"), (k % 5).cast("string"))).alias("value")),
        F.struct(F.lit("b").alias("field"), F.lit(None).cast("string").alias("value")), F.struct(F.lit("c").alias("field"), F.col("o_orderpriority").alias("value")))
    expected = o.select(k.alias("record_id"), F.explode(want).alias("x")).select("record_id", "x.*")
    said = li.select(F.col("l_orderkey").alias("record_id"), F.lit("a").alias("field"), F.concat(F.lit("v"), (F.col("l_suppkey") % 5).cast("string")).alias("value"))
    twice = o.filter("o_orderkey % 2 = 0").select(k.alias("record_id"), F.lit("c").alias("field"), F.col("o_orderpriority").alias("value"))
    m = J.value_metrics(expected, said.unionByName(twice).unionByName(twice))
    return m.select("field", "status", "support_n", "matched_n", "predicted_value_n", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def error_layers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(
        (F.col("event_id") % 2).alias("truth"), F.lit(0).cast("long").alias("predicted"),
        (F.col("event_type") != "click").alias("segmented"), (F.col("value") > 50).alias("extracted"),
        (F.col("user_id") % 3 != 0).alias("retrieved"), (F.col("event_type") != "view").alias("compared")
    )
    return J.error_layers(rows)


def grounded_spans(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    e = F.col("l_linenumber").cast("string")
    spans = li.select(
        F.col("l_orderkey").alias("doc_id"), e.alias("evidence_id"), F.col("l_returnflag").alias("text"), F.lit("A and N").alias("raw_text")
    ).groupBy("doc_id", "evidence_id", "raw_text").agg(F.max("text").alias("text"))
    uses = li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 2).alias("obligation_id"),
        F.when(F.col("l_linestatus") == "O", "action").otherwise("deadline").alias("field"), e.alias("evidence_id")
    )
    good, left = O.sanitize_spans(spans, uses)
    none = F.lit(None).cast
    return good.select("doc_id", "evidence_id", none("long").alias("obligation_id"), F.col("text").alias("what")).unionByName(
        left.distinct().select("doc_id", "evidence_id", "obligation_id", F.col("field").alias("what"))
    )


def grounded_actions(spark, sf_dir):
    """Actions of each type: a quote as it stands, one that does not, one spaced otherwise, one of another ending; without it the line of an anchor."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(t) for t, _ in _ANCHORED]), (k % len(_ANCHORED) + 1).cast("int"))
    phrase = F.element_at(F.array(*[F.lit(p) for _, p in _ANCHORED]), (k % len(_ANCHORED) + 1).cast("int"))
    line = F.concat(F.lit("Sinh viên "), phrase, F.lit(" số "), k.cast("string"))
    text = F.concat(F.lit("Dòng đầu\n  "), line, F.lit(". \nhết"))
    quote = F.when(k % 4 == 0, F.concat(F.lit("số "), k.cast("string"))).when(k % 4 == 1, "không có").when(
        k % 4 == 2, F.concat(F.upper(F.replace(line, F.lit(" "), F.lit("   "))), F.lit("."))).otherwise(F.concat(line, F.lit("!")))
    rows = o.select("o_orderkey", quote.alias("quote"), kind.alias("action_type"), text.alias("raw_text"))
    return O.ground_actions(rows, ("o_orderkey",))


def corpus_chunks(spark, sf_dir):
    """Chunks of documents as versions of 500 notices, with titles and the mark of the current version."""
    d = table(spark, sf_dir, "documents")
    v = d.groupBy(
        (F.col("doc_id") % 500).alias("notice_key"), F.md5("text").alias("content_hash")
    ).agg(F.min("doc_id").alias("version_id"), F.first("text").alias("raw_text"))
    head = d.groupBy((F.col("doc_id") % 500).alias("notice_key")).agg(F.max_by(F.md5("text"), "doc_id").alias("current_content_hash"))
    notices = head.select("notice_key", F.concat(F.lit("Tin "), F.col("notice_key").cast("string")).alias("title"))
    c = R.build_corpus(v.select("notice_key", "content_hash", "version_id", "raw_text"), head, notices)
    return c.select(
        "chunk_id", "notice_key", "title", "is_latest", F.col("publication_date").isNull().alias("undated"), F.md5("text").alias("text_md5")
    )


def _drafts(spark, sf_dir):
    """A draft for each order about the notice of its customer, with quotes that stand there, nearly stand there, and do not."""
    o = table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    raw = F.concat(
        F.lit("Sinh viên đăng ký  học phần.\nHạn "), day, F.lit(".\nLệ phí 50.000 đồng.\nNộp tại Phòng A\nKèm bảng điểm và ảnh thẻ\nTrừ sinh viên K21"))
    return o.select(
        k.alias("draft_id"), F.col("o_custkey").alias("notice_id"), F.lit(1).alias("version_id"), raw.alias("raw_text"),
        F.lit("register").alias("action_type"), F.when(k % 2 == 0, "đăng ký").otherwise("khác hẳn").alias("action_quote"),
        F.when(k % 4 == 0, "sinh viên K21").alias("audience_quote"), F.when(k % 3 == 0, day).alias("deadline_quote"),
        F.when(k % 7 == 0, "lệ phí 50.000  đồng").when(k % 7 == 1, "học phần").alias("amount_quote"),
        F.when(k % 5 == 0, "mặt trăng").otherwise("nộp  tại phòng a").alias("location_quote"),
        F.array(F.lit("bảng điểm"), F.lit("hộ chiếu"), F.lit("BẢNG  ĐIỂM và ảnh thẻ")).alias("document_quotes"),
        F.when(k % 6 == 0, F.array(F.lit("Trừ sinh viên K21"), F.lit(None).cast("string"), F.lit(""))).alias("exception_quotes"))


def drafted_obligations(spark, sf_dir):
    found = O.draft_obligations(_drafts(spark, sf_dir))
    lists = [F.array_join(c, "|").alias(c) for c in ("documents", "exceptions")]
    return found.select("draft_id", "obligation_id", "action_text", "audience", "deadline", "precision", "amount_text", "amount", "location", *lists)


def drafted_evidence(spark, sf_dir):
    found = O.draft_evidence(O.draft_obligations(_drafts(spark, sf_dir)))
    return found.select("notice_id", "evidence_id", "field", "text", F.col("start_char").cast("long"), F.col("end_char").cast("long"))


def folded_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(norm_text("text")).alias("norm_md5"), F.md5(fold_vietnamese(F.lower("source"))).alias("source_md5"))


_ALL = (
    search_index, notice_catalog, version_coverage, backfill_events, derived_queries, candidate_claims, forced_pairs, repaired_metadata,
    decided_spans, annotation_upsert, incomplete_annotations, case_checks, catalog_rows, expected_values, error_layers, grounded_spans,
    grounded_actions, corpus_chunks, drafted_obligations, drafted_evidence, folded_texts
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {
    "version_coverage": _OBS + "SELECT count(*) FILTER (WHERE v.h = k.h) AS current, count(*) FILTER (WHERE v.h <> k.h) AS historical, (SELECT count(*) FROM nation) AS relations FROM v JOIN k USING (notice_key)",
    "folded_texts": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[.,;:()]', '', 'g'), '\s+', ' ', 'g'))) AS norm_md5, md5(source) AS source_md5 FROM documents",
    "search_index": "SELECT o_orderkey AS notice_id, s_name AS category, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_text, recent FROM orders JOIN supplier ON s_suppkey = o_custkey % 100 LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS recent FROM events GROUP BY 1) ON user_id = o_orderkey",
    "notice_catalog": "SELECT c_custkey AS notice_id, n_name AS source_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS covered FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "backfill_events": """
WITH s AS (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1), c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, o_orderdate, CASE WHEN n > 1 THEN 'UPDATED' ELSE 'NEW' END AS outcome FROM orders JOIN s USING (o_custkey) LEFT JOIN c ON l_orderkey = o_orderkey WHERE o_orderdate >= m)
SELECT o_orderkey AS notice_id, outcome, strftime(o_orderdate, '%Y-%m-%d') AS day FROM b WHERE NOT (o_orderkey % 2 = 0 AND outcome = 'UPDATED')""",
    "derived_queries": "SELECT p_partkey AS obligation_id, 'action' AS kind, p_name AS text FROM part UNION ALL SELECT p_partkey, 'audience', p_name || ' ' || p_brand FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'document', p_name || ' ' || p_type FROM part",
    "candidate_claims": """
SELECT o_orderkey AS obligation_id, m AS mutation, strftime(o_orderdate + CASE WHEN m = 'deadline' THEN INTERVAL 4 DAY ELSE INTERVAL 0 DAY END, '%Y-%m-%d') AS deadline,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + CASE WHEN m = 'amount' THEN 500000 ELSE 0 END END AS amount, CASE WHEN m = 'location' THEN 'another place' ELSE o_orderpriority END AS location
FROM orders, (VALUES ('exact'), ('deadline'), ('amount'), ('location')) t(m) WHERE m <> 'amount' OR o_orderkey % 2 = 0""",
    "forced_pairs": """
SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 4 = 0 THEN 'CONFLICT' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict, CASE WHEN o_orderkey % 4 <> 0 THEN 0 WHEN o_orderkey % 3 = 2 THEN 3 ELSE 2 END::BIGINT AS compared,
  CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 3 = 2 THEN 'CONFLICT' ELSE 'INSUFFICIENT_EVIDENCE' END END AS amount_state FROM orders""",
    "grounded_actions": """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'số ' || o_orderkey ELSE 'Sinh viên ' || ['đăng kí', 'nộp  đơn', 'gửi hồ sơ', 'đóng học phí', 'tham gia', 'nhận', 'tự đánh giá', 'xem', 'hoàn tất'][o_orderkey % 9 + 1] || ' số ' || o_orderkey || '.' END AS grounded FROM orders""",
    "corpus_chunks": r"""
WITH RECURSIVE v AS (SELECT doc_id % 500 AS k, md5(text) AS h, min(doc_id) AS doc_id, any_value(text) AS text FROM documents GROUP BY 1, 2),
hd AS (SELECT doc_id % 500 AS k, arg_max(md5(text), doc_id) AS h FROM documents GROUP BY 1),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM v),
f AS (
  SELECT doc_id, ls, 1 AS i, 0 AS pos, -1 AS from_, 0 AS to_, 0 AS size, -1 AS cut_from, 0 AS cut_to FROM l
  UNION ALL
  SELECT doc_id, ls, i + 1, pos + length(ls[i]) + 1,
    CASE WHEN trim(ls[i]) = '' OR size + length(ls[i]) > 500 THEN -1 WHEN from_ >= 0 THEN from_ ELSE pos END,
    pos + length(ls[i]), CASE WHEN trim(ls[i]) = '' OR size + length(ls[i]) > 500 THEN 0 ELSE size + length(ls[i]) END,
    CASE WHEN trim(ls[i]) = '' THEN from_ WHEN size + length(ls[i]) > 500 THEN (CASE WHEN from_ >= 0 THEN from_ ELSE pos END) ELSE -1 END,
    CASE WHEN trim(ls[i]) = '' THEN to_ ELSE pos + length(ls[i]) END
  FROM f WHERE i <= len(ls)),
c AS (
  SELECT doc_id, cut_from AS a, cut_to AS b FROM f WHERE cut_from >= 0
  UNION ALL SELECT doc_id, from_, to_ FROM f WHERE i = len(ls) + 1 AND from_ >= 0)
SELECT c.doc_id || '_' || (row_number() OVER (PARTITION BY c.doc_id ORDER BY a) - 1) AS chunk_id, v.k AS notice_key, 'Tin ' || v.k AS title, v.h = hd.h AS is_latest, true AS undated, md5(v.text[a + 1:b]) AS text_md5
FROM c JOIN v ON c.doc_id = v.doc_id JOIN hd ON hd.k = v.k""",
    "repaired_metadata": "SELECT o_orderkey AS annotation, coalesce(c_name, '?') AS title FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey",
    "decided_spans": """
WITH r AS (SELECT o_orderkey AS record_id, CASE o_orderkey % 3 WHEN 0 THEN 'accept' ELSE 'edit' END AS decision, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS span,
  concat_ws(' ', o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END) AS t FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 2)
SELECT record_id, decision, span, (length(t) - length(replace(t, span, ''))) / length(span) = 1 AS valid FROM r""",
    "annotation_upsert": "SELECT o_custkey AS notice_id, max(o_orderkey) AS stamp, arg_max(o_orderstatus, o_orderkey) AS annotation_status FROM orders GROUP BY 1",
    "incomplete_annotations": "SELECT o_orderkey AS notice_id, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'not reviewed' WHEN o_custkey % 3 = 0 THEN 'no annotator' ELSE 'quote not in text' END AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_custkey % 3 = 0 OR o_orderkey % 2 = 1",
    "case_checks": r"""
WITH c AS (SELECT doc_id - CASE WHEN doc_id % 100 = 1 THEN 1 ELSE 0 END AS id, doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k FROM documents), v AS (
  SELECT 'case_id is not unique' AS rule FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'span not in text' FROM c WHERE doc_id % 10 = 0 UNION ALL SELECT 'unknown action' FROM c WHERE doc_id % 9 = 0
  UNION ALL SELECT 'claim count differs' FROM c WHERE doc_id % 2 = 0 UNION ALL SELECT 'same text twice' FROM c WHERE k IN (SELECT k FROM c GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'text is in the frozen set' FROM c WHERE k IN (SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) FROM benchmark))
SELECT rule, count(*) AS n FROM v GROUP BY 1""",
    "catalog_rows": "SELECT (n_nationkey % 20)::VARCHAR AS item, 'code is not unique' AS rule FROM nation GROUP BY 1 HAVING count(DISTINCT n_name) > 1 UNION ALL SELECT DISTINCT c_mktsegment, 'unknown source' FROM customer WHERE c_mktsegment = 'BUILDING'",
    "expected_values": """
WITH e AS (
  SELECT o_orderkey AS id, 'a' AS field, CASE WHEN o_orderkey % 3 <> 0 THEN 'v' || (o_orderkey % 5) END AS v FROM orders UNION ALL SELECT o_orderkey, 'b', NULL FROM orders UNION ALL SELECT o_orderkey, 'c', o_orderpriority FROM orders),
p AS (SELECT l_orderkey AS id, 'a' AS field, 'v' || (l_suppkey % 5) AS v FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT o_orderkey, 'c', o_orderpriority FROM orders, (VALUES (1), (2)) WHERE o_orderkey % 2 = 0),
c AS (
  SELECT field, count(v) AS s, (SELECT count(*) FROM e x SEMI JOIN p USING (id, field, v) WHERE x.field = e.field) AS m, (SELECT count(*) FROM p WHERE p.field = e.field) AS n FROM e GROUP BY 1),
r AS (SELECT *, CASE WHEN n > 0 THEN m / n END AS pr, m / s AS re FROM c WHERE s > 0)
SELECT field, 'MEASURED' AS status, s AS support_n, m AS matched_n, n::BIGINT AS predicted_value_n, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr > 0 AND re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f1 FROM r
UNION ALL SELECT field, 'NOT_YET_MEASURED', s, NULL, NULL, NULL, NULL, NULL FROM c WHERE s = 0""",
    "error_layers": "SELECT CASE WHEN event_id % 2 = 0 THEN 'right' WHEN event_type = 'click' THEN 'segmentation' WHEN value <= 50 THEN 'extraction' WHEN user_id % 3 = 0 THEN 'retrieval' WHEN event_type = 'view' THEN 'comparison' ELSE 'verdict' END AS layer, count(*) AS n FROM events GROUP BY 1",
    "grounded_spans": """
WITH s AS (SELECT l_orderkey AS d, l_linenumber AS e, max(l_returnflag) AS t FROM lineitem GROUP BY 1, 2 HAVING max(l_returnflag) IN ('A', 'N')),
u AS (SELECT l_orderkey AS d, l_partkey % 2 AS o, l_linestatus AS f, l_linenumber AS e FROM lineitem SEMI JOIN s ON s.d = l_orderkey AND s.e = l_linenumber),
k AS (SELECT * FROM u WHERE (d, o) IN (SELECT (d, o) FROM u WHERE f = 'O'))
SELECT d AS doc_id, e::VARCHAR AS evidence_id, NULL::BIGINT AS obligation_id, t AS what FROM s SEMI JOIN k USING (d, e)
UNION ALL SELECT DISTINCT d, e::VARCHAR, o, CASE WHEN f = 'O' THEN 'action' ELSE 'deadline' END FROM k""",
    "drafted_obligations": """
SELECT o_orderkey AS draft_id, 'o' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS obligation_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'đăng ký' ELSE 'Sinh viên đăng ký  học phần.' END AS action_text, CASE WHEN o_orderkey % 4 = 0 THEN 'sinh viên K21' END AS audience,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS deadline, CASE WHEN o_orderkey % 3 = 0 THEN 'date' END AS precision,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Lệ phí 50.000 đồng.' END AS amount_text, CASE WHEN o_orderkey % 7 = 0 THEN 50000 END::BIGINT AS amount,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'Nộp tại Phòng A' END AS location, 'bảng điểm|Kèm bảng điểm và ảnh thẻ' AS documents,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Trừ sinh viên K21' ELSE '' END AS exceptions FROM orders""",
    "drafted_evidence": """
WITH n AS (
  SELECT *, 'Sinh viên đăng ký  học phần.' || chr(10) || 'Hạn ' || strftime(o_orderdate, '%d/%m/%Y') || '.' || chr(10) || 'Lệ phí 50.000 đồng.' || chr(10) || 'Nộp tại Phòng A' || chr(10) || 'Kèm bảng điểm và ảnh thẻ' || chr(10) || 'Trừ sinh viên K21' AS raw FROM orders),
v(ord, field) AS (VALUES (0, 'action'), (1, 'audience'), (2, 'deadline'), (3, 'amount'), (4, 'location'), (5, 'document'), (6, 'document'), (7, 'exception')),
f AS (
  SELECT o_custkey, o_orderkey, raw, ord, field, CASE ord WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'đăng ký' ELSE 'Sinh viên đăng ký  học phần.' END
    WHEN 1 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'sinh viên K21' END WHEN 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END
    WHEN 3 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'Lệ phí 50.000 đồng.' END WHEN 4 THEN CASE WHEN o_orderkey % 5 <> 0 THEN 'Nộp tại Phòng A' END
    WHEN 5 THEN 'bảng điểm' WHEN 6 THEN 'Kèm bảng điểm và ảnh thẻ' ELSE CASE WHEN o_orderkey % 6 = 0 THEN 'Trừ sinh viên K21' END END AS text FROM n, v),
g AS (SELECT o_custkey, field, text, min(o_orderkey * 8 + ord) AS first, min(strpos(raw, text) - 1) AS a FROM f WHERE text IS NOT NULL GROUP BY 1, 2, 3)
SELECT o_custkey AS notice_id, 'e' || row_number() OVER (PARTITION BY o_custkey ORDER BY first) AS evidence_id, field, text, a::BIGINT AS start_char, (a + length(text))::BIGINT AS end_char FROM g""",
}
