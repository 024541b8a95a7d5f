"""Registered queries: identity, registry views, claims' other fields, comparisons, curation and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from herald.functions.urls import notice_id
from herald.operators import annotations as G
from herald.operators import claims as C
from herald.operators import evaluate as J
from herald.operators import monitoring as M
from herald.operators import obligations as O
from herald.operators import retrieval as R
from herald.operators import verify as V
from herald.operators import versions as N
from herald.plans.notices import _OBS, _classified
from herald.plans.tables import table
from herald.sources import registry


def _day(c, form="yyyy-MM-dd"):
    return F.date_format(c, form)


# --- sources and identity ---
def configured_sources(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("notes"), (F.col("s_acctbal") > 0).alias("enabled")
    )
    config = s.filter("source_id % 3 = 0").select(
        "source_id", F.when(F.col("source_id") % 2 == 0, "configured").alias("notes"), F.lit(False).alias("enabled")
    )
    return registry.configured(s, config, ["notes", "enabled"])


def official_ids(spark, sf_dir):
    """Official ids of URLs: on the host itself in any case, below it, elsewhere, and on another path."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    host = F.when(i % 4 == 1, "sub.notices.example").when(i % 4 == 2, "other.example").otherwise("Notices.example")
    url = F.concat(
        F.lit("https://"), host, F.when(i % 4 == 3, "/News/").otherwise("/thongbao/ID/"), i.cast("string"),
        F.when(i % 5 == 0, "?a=1").otherwise("")
    )
    return p.select("page_id", notice_id(url, "notices.example", r"(?i)/thongbao/id/(\d+)", "dut").alias("official_id"))


def resolved_identity(spark, sf_dir):
    """Events as fetches: clicks come by mirrors that claim the notice's id, some before the notice itself was seen."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    own = F.when(
        F.col("event_type") == "signup", F.concat(F.lit("https://notices.example//b/id/"), user)
    ).otherwise(F.concat(F.lit("http://notices.example/a/id/"), user, F.lit("/?utm_source=x")))
    url = F.when(F.col("event_type") == "click", F.concat(F.lit("https://mirror.example/"), user)).otherwise(own)
    obs = e.select("event_id", "ts", url.alias("canonical_url"), F.concat(F.lit("notice:"), user).alias("claimed"))
    return N.resolve_identity(
        obs, "notices.example", order=("ts", "event_id"), shared=F.col("claimed")
    ).select("event_id", "normalized_url", "notice_key")


def stored_payloads(spark, sf_dir):
    """Payloads of one source, and what the others add, each content once."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("raw_hash"), "source")
    have = d.filter("source = 'src0'").select("raw_hash").distinct()
    return N.append_only(have, d.filter("source != 'src0'").select("raw_hash"), ["raw_hash"])


def notice_detail(spark, sf_dir):
    """The head of notice 7 with its newest version."""
    c = _classified(spark, sf_dir)
    d = N.notice_detail(N.heads(c, order=("observed_at", "event_id")), N.versions(c), F.lit(7), version_id="observed_at")
    return d.select("notice_key", "current_content_hash", "first_observed_at", "content_hash")


def content_hashes(spark, sf_dir):
    """Hashes of the whole canonical record of each order."""
    o = table(spark, sf_dir, "orders")
    links = F.when(
        F.col("o_orderkey") % 2 == 0, F.array(F.col("o_orderstatus"), F.lit("b.pdf"), F.lit("A.pdf"))
    ).otherwise(F.expr("cast(array() as array<string>)"))
    title = F.concat(F.lit("  Tin  "), F.col("o_orderkey").cast("string"), F.lit(" "))
    return o.select(
        "o_orderkey",
        N.content_hash(
            title, F.when(F.col("o_orderkey") % 3 != 0, _day("o_orderdate")), F.concat(F.lit("a \n b "), F.col("o_orderpriority")), links
        ).alias("content_hash")
    )


# --- monitoring ---
def notice_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("notice_id"), "event_id", F.col("event_type").alias("outcome"),
        F.date_trunc("day", "ts").alias("observed_at")
    )
    return M.notice_events(e)


def utc_instants(spark, sf_dir):
    """Times with and without an offset, and none."""
    e = table(spark, sf_dir, "events")
    zone = F.when(F.col("event_id") % 4 == 1, "+07:00").when(F.col("event_id") % 4 == 2, "Z").otherwise("")
    text = F.when(F.col("event_id") % 4 != 3, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)).otherwise("soon")
    return e.select("event_id", _day(M.utc(text), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def rebuilt_chunks(spark, sf_dir):
    """Chunks after a third of the documents changed: theirs are cut anew, the others' stay."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("notice_id"), F.lit(1).alias("version_id"), F.col("text").alias("raw_text")
    )
    events = d.select("notice_id", F.when(F.col("notice_id") % 3 == 0, "UPDATED").otherwise("UNCHANGED").alias("outcome"))
    stored = d.select("notice_id", F.lit("old").alias("chunk_id"), F.lit(None).cast("string").alias("text"))
    out = M.rebuild_changed(stored, d, events, R.chunk_versions)
    return out.groupBy("notice_id").agg(
        F.count_if(F.col("chunk_id") == "old").alias("old"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")
    )


# --- claims ---
def claim_details(spark, sf_dir):
    """Places, papers, exceptions and understood fields of messages built of each order's columns."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("Sinh viên nộp đơn"), F.when(
            k % 2 == 0, F.concat(F.lit(" tại Phòng  A"), (k % 40).cast("string"))
        ).otherwise(""), F.when(k % 3 == 0, ", hồ sơ gồm CCCD và cccd, Bảng điểm").when(k % 3 == 1, ", CCCD").otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit("; trừ sinh viên K"), (k % 9 + 10).cast("string"))).otherwise(""))
    c = C.extract_claims(o.select(k.alias("message_id"), text.alias("text")))
    u = C.understood_fields(c).select("message_id", "claim_ix", F.array_join("understood", ",").alias("understood"))
    return c.select(
        "message_id", "claim_ix", F.col("location.normalized").alias("location"), F.array_join("documents", "|").alias("documents"),
        F.array_join("exceptions", "|").alias("exceptions"), F.length("claim_id").cast("long").alias("id_chars")
    ).join(u, ["message_id", "claim_ix"]).drop("claim_ix")


def supported_deadlines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Hạn "), _day("o_orderdate", "d-M-yyyy"), F.lit(" hoặc 31/02/2021"))
    claimed = F.when(F.col("o_orderkey") % 3 == 0, _day("o_orderdate")).when(
        F.col("o_orderkey") % 3 == 1, F.concat(_day("o_orderdate"), F.lit("T10:00:00+07:00"))
    ).otherwise("2021-02-28")
    return O.supported_deadlines(o.select("o_orderkey", text.alias("text"), claimed.alias("deadline"))).select("o_orderkey", "deadline")


def compared_fields(spark, sf_dir):
    """Audience and place of claims, on which no verdict rests."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    claimed = F.when(k % 4 == 0, "https://x.example").when(k % 4 == 1, F.upper("o_orderpriority")).when(k % 4 == 2, F.lit("Phòng B")).otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
    return o.select(
        "o_orderkey", V.compare_audience(F.when(k % 3 != 0, k % 3 == 1)).alias("audience"),
        V.compare_location(claimed, F.when(k % 8 == 0, F.lit("http://y.example")).otherwise(F.col("o_orderpriority"))).alias("location")
    )


# --- drafts and annotations ---
def _annotations(spark, sf_dir):
    """An annotation for each order, with an obligation for each of its lineitems."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    one = F.struct(
        F.col("l_linenumber").cast("string").alias("obligation_id"), F.struct(
            F.when(F.col("l_returnflag") == "R", "pay").otherwise("submit").alias("action_type")
        ).alias("action"),
        F.struct(
            _day("l_shipdate", "dd/MM/yyyy").alias("raw_text"), _day("l_shipdate").alias("normalized")
        ).alias("deadline"), F.when(F.col("l_returnflag") == "R", F.struct(F.floor("l_extendedprice").alias("value_vnd"))).alias("amount"),
        F.when(F.col("l_linestatus") == "O", F.struct(F.lit("Phòng A").alias("text"))).alias("location"), F.struct((F.col("l_linenumber") % 2 == 0).alias("applies_to_all_students")).alias("audience"))
    many = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("obligations"))
    return o.join(many, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("notice_id"), F.lit(1).alias("version_id"),
        F.when(F.col("o_orderstatus") == "F", "GOLD").otherwise("DRAFT").alias("annotation_status"), "obligations"
    )


def flat_obligations(spark, sf_dir):
    f = O.flatten_obligations(_annotations(spark, sf_dir))
    return f.select(
        "notice_id", "annotation_status", "obligation_id", "off_action", "off_deadline", "off_deadline_norm", "off_amount", "location",
        F.col("audience.applies_to_all_students").alias("for_all")
    )


def field_values(spark, sf_dir):
    """How often obligations have each action and place, and how many carry each tag."""
    flat = O.flatten_obligations(_annotations(spark, sf_dir))
    tagged = G.category_tags(
        flat, {"money": F.col("off_amount") > 30000, "open": F.col("location").isNull(), "all": F.col("audience.applies_to_all_students")}
    )
    tags = tagged.select(F.explode("tags").alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(
        F.lit("tag").alias("field"), "value", "n"
    )
    return G.field_distribution(flat, ["off_action", "location"]).unionByName(tags)


def evidence_numbers(spark, sf_dir):
    """Ids and offsets of quotes by their place in the text; those that do not occur are left out."""
    o = table(spark, sf_dir, "orders")
    raw = F.concat(_day("o_orderdate"), F.lit(" "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus"))
    q = o.select(
        F.col("o_orderkey").alias("doc_id"), raw.alias("raw_text"),
        F.explode(F.array(F.col("o_orderpriority"), _day("o_orderdate"), F.lit("absent"))).alias("quote")
    )
    return O.number_spans(q).select(
        "doc_id", "evidence_id", "quote", F.col("start_char").cast("long").alias("start_char"),
        F.col("end_char").cast("long").alias("end_char")
    )


def inexact_evidence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    s = o.select(
        k.alias("doc_id"), F.lit("e1").alias("evidence_id"), F.when(k % 7 == 0, "absent").otherwise(F.col("o_orderpriority")).alias("text"),
        F.when(k % 5 != 0, F.floor(k % 3 / 2).cast("int")).alias("start_char"),
        (F.floor(k % 3 / 2) + F.length("o_orderpriority")).cast("int").alias("end_char"),
        F.concat("o_orderpriority", F.lit("!")).alias("raw_text")
    )
    return O.inexact_evidence(s).select("doc_id", "rule")


def pack_manifest(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    obligations = li.select(
        F.col("l_orderkey").alias("notice_id"), F.lit(1).alias("version_id"), F.col("l_linenumber").alias("obligation_id"),
        F.when(F.col("l_returnflag") == "R", "REVIEWED").otherwise("DRAFT").alias("annotation_status")
    )
    return G.pack_manifest(G.gold_pack(o.select(F.col("o_orderkey").alias("notice_id"), F.lit(1).alias("version_id")), obligations))


def catalog_aliases(spark, sf_dir):
    """Customers' segments looked up among nations' programs by name or alias, and programs without an official source."""
    n = table(spark, sf_dir, "nation")
    flat = n.select(
        F.col("n_nationkey").cast("string").alias("official_code"), F.col("n_name").alias("program"),
        F.explode(F.array(F.concat(F.lit("Segment "), (F.col("n_nationkey") % 5).cast("string")), F.lower("n_name"))).alias("alias")
    )
    names = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit(" segment  "), (F.col("c_custkey") % 7).cast("string")).alias("name")
    )
    found = G.resolve_alias(names, flat).select(F.col("c_custkey").cast("string").alias("item"), F.col("official_code").alias("found"))
    programs = n.select(
        F.col("n_nationkey").cast("string").alias("official_code"),
        F.when(F.col("n_nationkey") % 2 == 0, "verified").otherwise("open").alias("status"), F.col("n_regionkey").alias("source_ref")
    )
    sources = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("source_ref"), F.when(F.col("r_regionkey") < 3, "official").otherwise("press").alias("source_type")
    )
    return found.unionByName(G.unverified_sources(programs, sources).select("item", F.col("rule").alias("found")))


# --- scores ---
def _states(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").cast("string").alias("d"), F.col("l_returnflag").alias("field"),
        F.when(F.col("l_quantity") > 10, F.col("l_linestatus")).alias("expected"),
        F.when(F.col("l_tax") > 0.02, F.col("l_linestatus")).alias("state")
    )


def field_accuracy(spark, sf_dir):
    return J.field_accuracy(_states(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


def macro_scores(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted"))
    m = J.macro_average(J.confusion_prf(l, [0, 1, 2]))
    return m.select("labels", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def model_qualification(spark, sf_dir):
    """Counts and status of three models: one with failures, one that returns the gold claims, one with other values and fewer claims."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    k = F.col("o_orderkey") % 50
    cases = o.select(F.col("o_orderkey").alias("case_id"), F.when(k == 7, "INVENTED_YEAR").when(k == 9, "UNGROUNDED_FIELD").when(k == 11, "INVALID_ACTION").alias("error"))
    key = [F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).alias("ix")]
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    gold = li.select(
        *key, F.col("l_returnflag").alias("action"), F.when(F.col("l_quantity") > 10, day).alias("deadline"),
        F.when(F.col("l_tax") > 0.02, F.col("l_partkey")).alias("amount"), F.col("l_linestatus").alias("audience"),
        F.array(F.col("l_returnflag"), F.lit("Đơn  xin")).alias("required_documents"))
    none = F.expr("cast(array() as array<string>)")
    other = li.filter("l_linenumber < 6").select(
        *key, F.when(F.col("l_discount") > 0.08, "Z").otherwise(F.col("l_returnflag")).alias("action"), day.alias("deadline"),
        F.when(F.col("l_tax") > 0.04, F.col("l_partkey")).alias("amount"), F.col("l_linestatus").alias("audience"),
        F.when(F.col("l_quantity") < 40, F.array(F.lit("đơn XIN"), F.col("l_returnflag"))).otherwise(none).alias("required_documents"))
    good = cases.filter("error is null")
    of_good = gold.join(good.select("case_id"), "case_id", "left_semi")
    models = {"failing": (cases, gold, other), "right": (good, of_good, gold), "other": (good, of_good, other)}
    rows = [J.qualification(*m).withColumn("model", F.lit(name)) for name, m in models.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def gold_claims(spark, sf_dir):
    """Gold claims of accepted records: the list where there is one that is not empty, else the single claim."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    many = li.filter("l_orderkey % 2 = 0").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.col("l_linenumber").cast("string"))).alias("gold_claims")
    )
    r = o.join(many, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("candidate").alias("state"),
        F.when(F.col("o_orderkey") % 6 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.col("gold_claims")).alias("gold_claims"), F.col("o_orderpriority").alias("gold_claim")
    )
    return J.expand_gold(r).select("record_id", F.col("ix").cast("long").alias("ix"), "claim")


def exact_values(spark, sf_dir):
    """Deadlines and money of notices, all right or not; a tenth of the notices are examples, some extractions fail."""
    li = table(spark, sf_dir, "lineitem")
    key = [F.col("l_orderkey").alias("notice_id"), F.when(F.col("l_returnflag") == "R", "money").otherwise("deadline").alias("field")]
    gold = li.select(*key, F.when(F.col("l_linenumber") < 4, F.col("l_linenumber").cast("string")).alias("value"))
    predicted = li.select(
        *key,
        F.when(
            F.col("l_linenumber") < 4, (F.col("l_linenumber") + F.when(F.col("l_orderkey") % 4 == 0, 1).otherwise(0)).cast("string")
        ).alias("value"),
        F.when(F.col("l_orderkey") % 7 == 0, "timeout").alias("error")
    )
    e = J.exact_match(gold, predicted, li.filter("l_orderkey % 10 = 0").select(F.col("l_orderkey").alias("notice_id")))
    return e.select(
        "field", "notices", "present", F.round("exact_all", 9).alias("exact_all"), F.round("exact_present", 9).alias("exact_present"),
        "errors"
    )


def stale_hits(spark, sf_dir):
    """How many of all vectors of a query's label are not current."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return J.stale_hits(
        e.join(F.broadcast(q), F.col("label") == F.col("own")).select("query_id", "vec_id"), e.filter("vec_id % 3 != 0"), "vec_id"
    )


_ALL = (
    configured_sources, official_ids, resolved_identity, stored_payloads, notice_detail, content_hashes, notice_events, utc_instants, rebuilt_chunks, claim_details, supported_deadlines, compared_fields, flat_obligations, field_values,
    evidence_numbers, inexact_evidence, pack_manifest, catalog_aliases, field_accuracy, macro_scores, model_qualification, gold_claims, exact_values, stale_hits,
)
QUERIES = {f.__name__: f for f in _ALL}
_FLAT = """
WITH f AS (SELECT l_orderkey AS notice_id, CASE WHEN o_orderstatus = 'F' THEN 'GOLD' ELSE 'DRAFT' END AS annotation_status, l_linenumber::VARCHAR AS obligation_id, CASE WHEN l_returnflag = 'R' THEN 'pay' ELSE 'submit' END AS off_action,
  strftime(l_shipdate, '%d/%m/%Y') AS off_deadline, strftime(l_shipdate, '%Y-%m-%d') AS off_deadline_norm, CASE WHEN l_returnflag = 'R' THEN floor(l_extendedprice)::BIGINT END AS off_amount, CASE WHEN l_linestatus = 'O' THEN 'Phòng A' END AS location, l_linenumber % 2 = 0 AS for_all
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
"""
SQL = {
    "configured_sources": "SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 6 = 0 THEN 'configured' ELSE s_name END AS notes, CASE WHEN s_suppkey % 3 = 0 THEN false ELSE s_acctbal > 0 END AS enabled FROM supplier",
    "official_ids": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'dut:' || page_id END AS official_id FROM pages",
    "resolved_identity": """
WITH o AS (SELECT event_id, ts, user_id, 'https://' || CASE event_type WHEN 'click' THEN 'mirror.example/' || user_id WHEN 'signup' THEN 'notices.example/b/id/' || user_id ELSE 'notices.example/a/id/' || user_id END AS url, event_type <> 'click' AS own FROM events),
u AS (SELECT url, user_id, own, arg_min(event_id, (ts, event_id)) AS e, min(ts) AS t FROM o GROUP BY 1, 2, 3),
a AS (SELECT user_id, arg_min(url, (t, e)) AS anchor, min((t, e)) AS at_ FROM u WHERE own GROUP BY 1)
SELECT event_id, url AS normalized_url, CASE WHEN at_ < (t, e) THEN anchor ELSE url END AS notice_key FROM o JOIN u USING (url) LEFT JOIN a ON a.user_id = o.user_id""",
    "stored_payloads": "SELECT DISTINCT sha256(text) AS raw_hash FROM documents",
    "notice_detail": _OBS + "SELECT notice_key, k.h AS current_content_hash, a AS first_observed_at, (SELECT arg_max(h, seen) FROM v WHERE notice_key = 7) AS content_hash FROM k WHERE notice_key = 7",
    "content_hashes": r"""
SELECT o_orderkey, sha256('{"attachments":[' || CASE WHEN o_orderkey % 2 = 0 THEN array_to_string(list_sort(['"' || o_orderstatus || '"', '"b.pdf"', '"A.pdf"']), ',') ELSE '' END || '],"publication_date":'
  || CASE WHEN o_orderkey % 3 <> 0 THEN '"' || strftime(o_orderdate, '%Y-%m-%d') || '"' ELSE 'null' END || ',"raw_text":"a b ' || o_orderpriority || '","title":"Tin ' || o_orderkey || '"}') AS content_hash FROM orders""",
    "notice_events": "SELECT user_id AS notice_id, event_type AS outcome, date_trunc('day', ts)::TIMESTAMP AS observed_at, min(event_id) AS event_id FROM events GROUP BY ALL",
    "utc_instants": "SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS utc FROM events",
    "rebuilt_chunks": r"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id % 3 = 0),
f AS (
  SELECT doc_id, ls, 1 AS i, 0 AS pos, -1 AS from_, 0 AS to_, 0 AS size, 0 AS chars FROM l
  UNION ALL
  SELECT doc_id, ls, i + 1, pos + length(ls[i]) + 1,
    CASE WHEN trim(ls[i]) = '' OR size + length(ls[i]) > 500 THEN -1 WHEN from_ >= 0 THEN from_ ELSE pos END,
    pos + length(ls[i]), CASE WHEN trim(ls[i]) = '' OR size + length(ls[i]) > 500 THEN 0 ELSE size + length(ls[i]) END,
    chars + CASE WHEN trim(ls[i]) = '' THEN CASE WHEN from_ >= 0 THEN to_ - from_ ELSE 0 END WHEN size + length(ls[i]) > 500 THEN pos + length(ls[i]) - CASE WHEN from_ >= 0 THEN from_ ELSE pos END ELSE 0 END
  FROM f WHERE i <= len(ls)),
d AS (SELECT doc_id, chars + CASE WHEN from_ >= 0 THEN to_ - from_ ELSE 0 END AS chars FROM f WHERE i = len(ls) + 1)
SELECT doc_id AS notice_id, 1::BIGINT AS old, 0::BIGINT AS chars FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 0, chars FROM d WHERE chars > 0""",
    "claim_details": """
SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Phòng A' || (o_orderkey % 40) || CASE o_orderkey % 3 WHEN 0 THEN ', hồ sơ gồm CCCD và cccd, Bảng điểm' WHEN 1 THEN ', CCCD' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '' END END AS location,
  CASE WHEN o_orderkey % 3 = 0 THEN 'CCCD|Bảng điểm' ELSE '' END AS documents, CASE WHEN o_orderkey % 5 = 0 THEN 'trừ sinh viên K' || (o_orderkey % 9 + 10) ELSE '' END AS exceptions, 64::BIGINT AS id_chars,
  concat_ws(',', 'action', CASE WHEN o_orderkey % 5 = 0 THEN 'audience' END, CASE WHEN o_orderkey % 2 = 0 THEN 'location' END, CASE WHEN o_orderkey % 3 = 0 THEN 'documents' END, CASE WHEN o_orderkey % 5 = 0 THEN 'exceptions' END) AS understood FROM orders""",
    "supported_deadlines": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT10:00:00+07:00') END AS deadline FROM orders",
    "compared_fields": """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'MATCH' ELSE 'INSUFFICIENT_EVIDENCE' END AS audience,
  CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'CONFLICT' ELSE 'MATCH' END AS location FROM orders""",
    "flat_obligations": _FLAT + "SELECT * FROM f",
    "field_values": _FLAT + """
SELECT 'off_action' AS field, off_action AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'location', location, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'tag', 'money', count(*) FROM f WHERE off_amount > 30000 UNION ALL SELECT 'tag', 'open', count(*) FROM f WHERE location IS NULL UNION ALL SELECT 'tag', 'all', count(*) FROM f WHERE for_all""",
    "evidence_numbers": """
SELECT o_orderkey AS doc_id, 'e1' AS evidence_id, strftime(o_orderdate, '%Y-%m-%d') AS quote, 0::BIGINT AS start_char, 10::BIGINT AS end_char FROM orders
UNION ALL SELECT o_orderkey, 'e2', o_orderpriority, 11, 11 + length(o_orderpriority) FROM orders""",
    "inexact_evidence": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 = 0 THEN 'text not in source' ELSE 'text not at its offsets' END AS rule FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderkey % 5 <> 0 AND o_orderkey % 3 = 2)",
    "pack_manifest": "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS notices, count(l_orderkey) AS accepted, count(*) - count(l_orderkey) AS candidates FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey",
    "catalog_aliases": """
SELECT c_custkey::VARCHAR AS item, (SELECT min(n_nationkey::VARCHAR) FROM nation WHERE n_nationkey % 5 = c_custkey % 7) AS found FROM customer
UNION ALL SELECT n_nationkey::VARCHAR, 'verified without official source' FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey >= 3""",
    "field_accuracy": "SELECT l_returnflag AS field, count(*) AS n, count(*) FILTER (WHERE (l_quantity > 10) = (l_tax > 0.02)) AS right, round(count(*) FILTER (WHERE (l_quantity > 10) = (l_tax > 0.02)) / count(*), 9) AS accuracy FROM lineitem GROUP BY 1",
    "macro_scores": """
WITH d(label) AS (VALUES (0), (1), (2)), c AS (SELECT label, count(*) FILTER (WHERE quality = label AND toxic = label) AS tp, count(*) FILTER (WHERE quality <> label AND toxic = label) AS fp, count(*) FILTER (WHERE quality = label AND toxic <> label) AS fn FROM d, labels GROUP BY 1),
s AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, tp / (tp + fn) AS r FROM c WHERE tp + fn > 0)
SELECT count(*) AS labels, round(avg(p), 9) AS precision, round(avg(r), 9) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 9) AS f1 FROM s""",
    "model_qualification": """
WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 50 WHEN 7 THEN 'INVENTED_YEAR' WHEN 9 THEN 'UNGROUNDED_FIELD' WHEN 11 THEN 'INVALID_ACTION' END AS error FROM orders),
l AS (SELECT *, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS ix, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem SEMI JOIN c ON id = l_orderkey),
g AS (
  SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY ix) AS n, l_returnflag AS action, CASE WHEN l_quantity > 10 THEN day END AS deadline, CASE WHEN l_tax > 0.02 THEN l_partkey END AS amount, l_linestatus AS audience,
    list_sort([lower(l_returnflag), 'đơn xin']) AS docs FROM l),
r AS (
  SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY ix) AS n, CASE WHEN l_discount > 0.08 THEN 'Z' ELSE l_returnflag END AS action, day AS deadline, CASE WHEN l_tax > 0.04 THEN l_partkey END AS amount, l_linestatus AS audience,
    CASE WHEN l_quantity < 40 THEN list_sort(['đơn xin', lower(l_returnflag)]) END AS docs FROM l WHERE l_linenumber < 6),
m(model) AS (VALUES ('failing'), ('right'), ('other')),
cm AS (SELECT model, id, error FROM m, c WHERE model = 'failing' OR error IS NULL),
rm AS (SELECT 'failing' AS model, * FROM r UNION ALL SELECT 'other', * FROM r UNION ALL SELECT 'right', * FROM g),
k AS (
  SELECT model, id, error, coalesce(gn, 0) AS g, coalesce(rn, 0) AS r FROM cm LEFT JOIN (SELECT id, count(*) AS gn FROM g GROUP BY 1) USING (id) LEFT JOIN (SELECT model, id, count(*) AS rn FROM rm GROUP BY 1, 2) USING (model, id)),
j AS (
  SELECT model, (g.action = r.action) IS NOT TRUE OR (g.deadline IS DISTINCT FROM r.deadline) OR (g.amount IS DISTINCT FROM r.amount) OR (g.audience IS DISTINCT FROM r.audience) OR (g.docs IS DISTINCT FROM r.docs) AS x,
    (g.action IS DISTINCT FROM r.action)::INT + (g.deadline IS DISTINCT FROM r.deadline)::INT + (g.amount IS DISTINCT FROM r.amount)::INT + (g.audience IS DISTINCT FROM r.audience)::INT + (g.docs IS DISTINCT FROM r.docs)::INT AS wrong
  FROM cm JOIN g USING (id) LEFT JOIN rm r USING (model, id, n) WHERE error IS NULL),
w AS (SELECT model, sum(wrong) AS wrong FROM j GROUP BY 1),
s AS (
  SELECT model, count(*) AS sample_count, sum(g)::BIGINT AS expected_claim_count, coalesce(sum(r) FILTER (WHERE error IS NULL), 0)::BIGINT AS returned_claim_count,
    coalesce(sum(greatest(g - r, 0)) FILTER (WHERE error IS NULL), 0)::BIGINT AS missing_claims, coalesce(sum(greatest(r - g, 0)) FILTER (WHERE error IS NULL), 0)::BIGINT AS unexpected_claims,
    count(*) FILTER (WHERE error IS NULL) AS adapter_success_count, count(*) FILTER (WHERE error IS NOT NULL) AS adapter_failure_count, count(*) FILTER (WHERE error = 'INVALID_ACTION') AS invalid_output_count,
    count(*) FILTER (WHERE error = 'UNGROUNDED_FIELD') AS grounding_violation_count, count(*) FILTER (WHERE error = 'INVENTED_YEAR') AS invented_year_violation_count, count(*) FILTER (WHERE error = 'INVALID_ACTION') AS invalid_action_violation_count
  FROM k GROUP BY 1)
SELECT s.*, wrong::BIGINT AS field_mismatches, CASE WHEN adapter_failure_count > 0 THEN 'QUALIFICATION_BLOCKED' WHEN missing_claims + unexpected_claims + wrong > 0 THEN 'MEASURED_REQUIRES_HUMAN_REVIEW' ELSE 'QUALIFIED_FOR_EVALUATED_FIELDS_ONLY' END AS status
FROM s JOIN w USING (model)""",
    "gold_claims": """
SELECT o_orderkey AS record_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber::VARCHAR) - 1 AS ix, l_linenumber::VARCHAR AS claim FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0
UNION ALL SELECT o_orderkey, 0, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 2 = 1 OR o_orderkey % 6 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))""",
    "exact_values": """
WITH g AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN 'money' ELSE 'deadline' END AS field, count(*) FILTER (WHERE l_linenumber < 4) AS n FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1, 2),
s AS (SELECT *, id % 7 <> 0 AND (n = 0 OR id % 4 <> 0) AS same FROM g)
SELECT field, count(*) AS notices, count(*) FILTER (WHERE n > 0) AS present, round(count(*) FILTER (WHERE same) / count(*), 9) AS exact_all, round(count(*) FILTER (WHERE same AND n > 0) / count(*) FILTER (WHERE n > 0), 9) AS exact_present, count(*) FILTER (WHERE id % 7 = 0) AS errors FROM s GROUP BY 1""",
    "stale_hits": "SELECT count(*) AS hits, count(*) FILTER (WHERE e.vec_id % 3 = 0) AS stale FROM embeddings e JOIN embeddings q ON e.label = q.label AND q.vec_id % 50 = 0",
}
