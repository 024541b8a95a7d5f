"""Registered queries: pages, sources, annotations, obligations and evaluation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from herald.operators import annotations as G
from herald.operators import evaluate as J
from herald.operators import obligations as O
from herald.plans.tables import table
from herald.sources import files, pages, registry


# --- pages and sources ---
def _dated_pages(spark, sf_dir):
    """All pages; two of three get a dated notice with attachments, in some the text too short, before their own content."""
    i = F.col("page_id")
    at = F.date_format(
        F.make_timestamp(
            F.lit(2026), (i % 12 + 1).cast("int"), (i % 28 + 1).cast("int"), (i % 24).cast("int"), (i % 60).cast("int"), F.lit(0)
        ),
        "dd/MM/yyyy HH:mm"
    )
    body = F.when(
        i % 3 == 1,
        F.concat(
            F.lit("<p>Thông báo  số "), i.cast("string"), F.lit(" gửi sinh viên.</p><p>Sinh viên xem tệp.</p><p>Sinh viên xem tệp.</p>")
        )
    ).otherwise(F.lit("<p>Ngắn</p>"))
    head = F.concat(
        F.lit("<h1>Trang</h1><h2>Tin "), i.cast("string"), F.when(i % 2 == 0, " <b>Hot</b>").otherwise(""), F.lit("</h2><span>"), at,
        F.lit("</span>")
    )
    files = F.concat(
        F.lit('<a href="/f/'), i.cast("string"), F.lit('.PDF?x=1"></a><a href="/f/a.html"></a><iframe src="https://drive.google.com/f'),
        i.cast("string"), F.lit('"></iframe><script>no()</script><div>Các thông tin khác</div><p>Nicht mehr.</p>')
    )
    return table(spark, sf_dir, "pages").withColumn(
        "html", F.when(i % 3 == 0, F.col("html")).otherwise(F.concat(head, body, files, F.coalesce("html", F.lit(""))))
    )


def page_notices(spark, sf_dir):
    """Notices of all pages: title, date, text, attachments, and the number of links."""
    n = pages.parse_notices(_dated_pages(spark, sf_dir))
    return n.filter("page_id % 3 != 0").select("page_id", "title", F.date_format("publication_date", "yyyy-MM-dd HH:mm").alias("published_utc"), "raw_text", "parse_mode", F.size("links").cast("long").alias("links"), F.array_join(F.transform("attachments", lambda a: F.regexp_replace(a, "^https?://[^/]*", "")), " ").alias("attachments")).unionByName(
        n.filter("page_id % 3 = 0").select("page_id", F.md5("title").alias("title"), F.date_format("publication_date", "yyyy-MM-dd HH:mm").alias("published_utc"), (F.col("title") == F.col("raw_text")).cast("string").alias("raw_text"), "parse_mode", F.size("links").cast("long").alias("links"), F.array_join("attachments", " ").alias("attachments")))


def page_links(spark, sf_dir):
    """Distinct links of each page, all of them on its own host."""
    n = pages.parse_notices(table(spark, sf_dir, "pages"))
    return n.select("page_id", F.explode(F.array_distinct("links")).alias("link")).groupBy("page_id").agg(F.count("*").alias("links"))


def discovered_links(spark, sf_dir):
    """Official notice links of pages that list one of every kind: double, relative, foreign and no notice; at most two a page."""
    i = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<a href="/Thongbao/id/'), i, F.lit('">a</a><a href="https://notices.example/thongbao/ID/7'), i,
        F.lit('">b</a><a href="/Thongbao/id/'), i,
        F.lit(
            '">c</a><a href="https://other.example/Thongbao/id/1">d</a><a href="/x">e</a><a href="https://sub.notices.example/Thongbao/id/3">f</a>'
        )
    )
    n = pages.parse_notices(
        table(spark, sf_dir, "pages").select("page_id", F.lit("https://notices.example/list").alias("url"), html.alias("html"))
    )
    return pages.discover_links(n, "notices.example", limit=2).select(
        "page_id", "link", "external_id", F.col("position").cast("long").alias("position")
    )


def page_text(spark, sf_dir):
    """Title and visible text of pages; every ninth is of a media type that is not read."""
    p = table(spark, sf_dir, "pages").withColumn(
        "media_type", F.when(F.col("page_id") % 9 == 0, "application/pdf").otherwise("text/html; charset=utf-8")
    )
    return pages.visible_text(p).select("page_id", "title", F.md5("text").alias("text_md5"), "status")


def listing_gate(spark, sf_dir):
    """Listings without their expected marker as dead letters."""
    p = table(spark, sf_dir, "pages").withColumn("source_id", F.col("page_id") % 5)
    good, bad = pages.marker_gate(p, F.when(F.col("page_id") % 2 == 0, F.lit("<ARTICLE>")).otherwise(F.lit("<nav>")))
    letters = pages.dead_letters(bad, "listing", "MARKER_MISSING", F.lit("expected marker absent"), F.lit("2026-01-01"))
    return letters.select("source_id", "url", "stage", "error_type", "message", "failed_at").unionByName(
        good.select(
            "source_id", "url", F.lit("parsed").alias("stage"), F.lit(None).cast("string").alias("error_type"),
            F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("failed_at")
        )
    )


def source_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.lit("2020").alias("updated_at")
    )
    seed = s.filter("source_id % 2 = 0").select(
        (F.col("source_id") + F.when(F.col("source_id") % 4 == 0, 1_000_000).otherwise(0)).alias("source_id"),
        F.when(F.col("source_id") % 3 == 0, "renamed").otherwise(F.col("name")).alias("name")
    )
    return registry.upsert_sources(s, seed, F.lit("2026"), ("name",))


def source_missing(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))
    return registry.insert_missing(s.filter("source_id % 3 != 0"), s.withColumn("name", F.lit("seed")))


def source_health(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(
        F.col("event_type") == "error", F.element_at(F.array(*map(F.lit, (403, 429, 500, 404))), (F.col("event_id") % 4 + 1).cast("int"))
    ).when(F.col("event_type") == "click", None).otherwise(200)
    h = registry.health(status, F.col("event_id") % 11 != 0, F.col("value") * 10, F.col("event_id") % 13 != 0)
    checks = e.select(
        F.col("user_id").alias("source_id"), F.col("ts").alias("checked_at"), F.col("event_id").alias("check_id"), h.alias("health")
    )
    return registry.apply_health(checks)


def health_log(spark, sf_dir):
    """The log of checks after a second delivery that repeats every third of them."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), F.col("ts").alias("checked_at"), F.col("event_id").alias("check_id"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("HEALTHY").alias("health")
    )
    return registry.health_snapshots(e.filter("check_id % 3 != 1"), e.filter("check_id % 3 != 2"))


def dataset_fingerprint(spark, sf_dir):
    return files.fingerprint(table(spark, sf_dir, "documents"))


# --- annotations ---
def _spans(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.concat(F.lit("hạn "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.col("o_orderpriority"))
    return o.select(
        F.col("o_orderkey").alias("notice_id"), F.concat(F.lit("e"), (F.col("o_orderkey") % 2).cast("string")).alias("evidence_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"), F.lit(4).alias("start_char"),
        F.when(F.col("o_orderkey") % 29 == 0, None).when(F.col("o_orderkey") % 17 == 0, 13).otherwise(14).alias("end_char"),
        raw.alias("raw_text")
    )


def annotation_violations(spark, sf_dir):
    """Every broken rule of annotations of all orders, each rule broken by some."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    deadline = F.when(
        k % 2 == 1, F.concat(day, F.when(k % 3 == 0, "T10:00:00").otherwise("T10:00:00+07:00"))
    ).when(k % 19 == 0, "2026-02-30").otherwise(day)
    again = lambda df, n: df.unionByName(df.filter(F.col("notice_id") % n == 0))
    obligations = o.select(
        k.alias("notice_id"), (F.col("o_custkey") % 3).alias("obligation_id"), deadline.alias("deadline"), F.when(k % 2 == 1, "datetime").otherwise("date").alias("precision"), F.lit(None).cast("string").alias("timezone"),
        F.when(k % 23 == 0, -1).otherwise(F.floor("o_totalprice")).alias("amount"), F.lit("2026-01-02").alias("event_start"), F.when(k % 41 == 0, "2026-01-01").otherwise("2026-01-03").alias("event_end"))
    uses = li.select(
        F.col("l_orderkey").alias("notice_id"), F.col("l_linenumber").alias("obligation_id"),
        F.concat(F.lit("e"), (F.col("l_linenumber") % 2).cast("string")).alias("evidence_id")
    )
    relations = li.select(F.col("l_orderkey").alias("notice_id"), F.col("l_suppkey").alias("target_notice_id"))
    v = G.annotation_violations(again(_spans(spark, sf_dir), 31), again(obligations, 37), uses, relations)
    return v.select("notice_id", "rule", "item").distinct()


def review_batch(spark, sf_dir):
    """Ten documents to review by keyword score, quotas for three sources: a top-k report."""
    d = table(spark, sf_dir, "documents")
    scored = d.select(
        F.col("doc_id").alias("notice_id"), F.col("source").alias("source_id"),
        G.keyword_score(F.col("text"), ("the ", "licen", "rights", "of ", "und ")).cast("long").alias("score")
    )
    return G.select_batch(scored, {"src1": 4, "src2": 3, "src3": 3}, 10).select("notice_id", "source_id", "score")


def promote_drafts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("notice_id"), F.lit("GOLD").alias("annotation_status"))
    drafts = o.filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("notice_id"), F.when(F.col("o_orderstatus") == "F", "PROMOTED").otherwise("DRAFT").alias("state"),
        F.when(F.col("o_custkey") % 2 == 0, "someone").alias("reviewer")
    )
    return G.promote(a, drafts, ["notice_id"])


def gold_pack(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    obligations = li.select(
        F.col("l_orderkey").alias("notice_id"), F.lit(1).alias("version_id"), F.col("l_linenumber").cast("long").alias("obligation_id"),
        F.when(F.col("l_returnflag") == "R", "REVIEWED").otherwise("DRAFT").alias("annotation_status")
    )
    return G.gold_pack(
        o.select(F.col("o_orderkey").alias("notice_id"), F.lit(1).alias("version_id")), obligations
    ).select("notice_id", "obligation_id", "state")


def field_support(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deadline"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("amount")
    )
    return G.field_support(o, ["deadline", "amount"], "o_orderpriority")


# --- obligations ---
def _notices(spark, sf_dir):
    """A notice for each order: a payment or a registration with deadline, amount and place, and then something to look up."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Tất cả sinh viên nộp học phí "), (F.col("o_orderkey") % 900 + 100).cast("string"), F.lit(".000 đồng trước 17h30 "), day, F.lit(". Địa điểm: Phòng A"), (F.col("o_orderkey") % 9).cast("string"), F.lit(".\nKiểm tra thông tin."))).otherwise(
        F.concat(F.lit("Sinh viên chính quy khóa 2021 đăng ký học phần từ 01/01/2020 đến "), day, F.lit(", hồ sơ: CCCD; bảng điểm")))
    return o.select(F.col("o_orderkey").alias("notice_id"), F.lit(1).alias("version_id"), text.alias("raw_text"))


def rule_obligations(spark, sf_dir):
    """Every obligation that the rules find, with the audience's names."""
    r = O.rule_extract(_notices(spark, sf_dir))
    return r.select(
        "notice_id", F.col("ordinal").cast("long").alias("ordinal"), F.array_join("audience.programs", "|").alias("programs"),
        "action_type", "action_text", F.col("deadline.normalized").alias("deadline"), "amount_vnd", "location",
        F.array_join("documents", "|").alias("documents"), F.array_join("audience.cohorts", ",").alias("cohorts"),
        F.col("audience.applies_to_all_students").alias("for_all")
    )


def ground_quotes(spark, sf_dir):
    """First lines as they are, with other spacing, with another last letter, and foreign quotes, against the whole text of their document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.split("text", "\n")[0]
    k = F.col("doc_id") % 4
    quote = F.when(k == 0, first).when(k == 1, F.replace(first, F.lit(" "), F.lit("  "))).when(
        (k == 2) & F.length(first).between(20, 150), F.concat(F.left(first, F.length(first) - 1), F.lit("\u00a4"))
    ).when(k == 2, first).otherwise("zzz 9999")
    return O.ground(
        d.select(F.col("doc_id").alias("quote_id"), quote.alias("quote"), F.col("text").alias("raw_text"))
    ).select("quote_id", F.md5("grounded").alias("grounded_md5"))


def ground_kinds(spark, sf_dir):
    """Quotes of a notice about each order: an inner part, one over two lines, one with accents apart, a near one, none, one in capitals."""
    o = table(spark, sf_dir, "orders")
    n, day, k = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.col("o_orderkey") % 6
    text = F.concat(F.lit("Thông báo số "), n, F.lit(".\nSinh viên nộp học phí\ntrước ngày "), day, F.lit(". Hết."))
    apart = F.concat(F.lit(unicodedata.normalize("NFD", "Thông báo số ")), n, F.lit("."))
    quote = F.when(k == 0, "nộp học phí").when(k == 1, F.concat(F.lit("Sinh viên nộp học phí trước ngày "), day, F.lit("."))).when(k == 2, apart).when(
        k == 3, F.concat(F.lit("Sinh viên nộp học phi trước ngày "), day, F.lit("!"))).when(k == 4, "không có ở đó").otherwise("SINH VIÊN  NỘP HỌC PHÍ")
    return O.ground(o.select(F.col("o_orderkey").alias("quote_id"), quote.alias("quote"), text.alias("raw_text")))


def payload_errors(spark, sf_dir):
    """Model outputs about each order: right ones, each kind of wrong one, and wrong ones in several claims."""
    o = table(spark, sf_dir, "orders")
    k, n = F.col("o_orderkey") % 14, F.col("o_orderkey").cast("string")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    message = F.concat(F.lit("Sinh viên "), n, F.lit(" nộp đơn "), F.col("o_orderpriority"), F.lit(" trước "), day)
    base = {
        "claim_text": F.concat(n, F.lit(" nộp đơn")), "action": F.lit("nộp"), "action_normalized": F.lit("submit"), "deadline_raw": day,
        "deadline_normalized": F.date_format("o_orderdate", "yyyy-MM-dd"), "amount_value": F.lit(None).cast("string"),
        "audience": F.lit(None).cast("string")
    }
    wrong = {
        1: {"claim_text": F.concat(n, F.lit(" khác"))}, 2: {"action_normalized": F.lit("fly")}, 3: {"deadline_raw": F.lit("30/9")},
        4: {"amount_value": F.lit(1.5)}, 5: {"audience": F.lit("ai đó")}, 6: {"verdict": F.lit("VERIFIED")}, 9: {"amount_value": F.lit("5")},
        10: {"deadline_normalized": F.lit(""), "deadline_raw": F.lit(None).cast("string"), "amount_value": F.lit(5)},
        13: {"required_documents": F.array(F.lit("đơn"), F.lit("giấy khai sinh"))}
    }
    one = lambda more: F.to_json(F.struct(*[v.alias(c) for c, v in {**base, **more}.items()]))
    several = lambda *claims: F.concat(F.lit('{"claims":['), F.concat_ws(",", *claims), F.lit("]}"))
    payload = F.when(k == 7, '{"other":1}').when(k == 8, "[")
    for i, more in wrong.items():
        payload = payload.when(k == i, several(one(more)))
    payload = payload.when(k == 11, several(one({}), one(wrong[2]), one(wrong[6]))).when(
        k == 12, several(one({}), F.concat(F.lit('{"verdict":null,"claim_text":"'), n, F.lit('"}')), one(wrong[1])))
    return O.payload_errors(
        o.select(F.col("o_orderkey").alias("output_id"), message.alias("message"), payload.otherwise(several(one({}), one({}))).alias("payload"))
    )


# --- evaluation ---
def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("predicted"))


def confusion(spark, sf_dir):
    c = J.confusion_prf(_labels(spark, sf_dir), [0, 1, 2])
    return c.select(
        F.col("label").cast("long").alias("label"), F.col("support").cast("long").alias("support"),
        F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1")
    )


def accuracy(spark, sf_dir):
    return J.accuracy(_labels(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


def atom_prf(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    atoms = lambda c: li.select(
        F.col("l_orderkey").alias("notice_id"), F.col("l_returnflag").alias("field"), F.col(c).cast("string").alias("atom")
    )
    a = J.atom_prf(
        atoms("l_linenumber"),
        li.select(
            F.col("l_orderkey").alias("notice_id"), F.col("l_returnflag").alias("field"),
            (F.col("l_partkey") % 5).cast("string").alias("atom")
        )
    )
    return a.select("field", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def retrieval_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    ranked = F.col("vec_id") % 10 + 1
    r = e.join(
        F.broadcast(q), (F.col("vec_id") >= F.col("query_id")) & (F.col("vec_id") < F.col("query_id") + 10)
    ).select("query_id", "vec_id", ranked.alias("rank"))
    rel = e.join(F.broadcast(q), F.col("label") == F.col("own")).select("query_id", "vec_id")
    m = J.retrieval_metrics(q, r, rel, "vec_id")
    return m.select("queries", *[F.round(c, 9).alias(c) for c in m.columns if c != "queries"])


def mutations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("deadline"),
        F.col("o_orderpriority").alias("location")
    )
    return J.mutate_cases(o)


def leakage(spark, sf_dir):
    """Documents whose folded text another document of a lower id has too."""
    d = table(spark, sf_dir, "documents")
    return J.leakage(d.select(F.col("doc_id").alias("case_id"), "text"), d.filter("source = 'src0'").select("text"))


def contained_passages(spark, sf_dir):
    return J.contained(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def price_percentiles(spark, sf_dir):
    p = J.percentiles(table(spark, sf_dir, "orders"), "o_totalprice")
    at = J.percentile_at(table(spark, sf_dir, "orders"), "o_totalprice", 0.95)
    return p.crossJoin(at).select(
        "n", F.round("mean", 4).alias("mean"), F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"),
        F.col("value").alias("p95_at")
    )  # one row each


def change_classes(spark, sf_dir):
    l = _labels(spark, sf_dir)
    before = l.select(F.col("doc_id").alias("case_id"), (F.col("truth") == 1).alias("right"))
    after = l.select(F.col("doc_id").alias("case_id"), (F.col("predicted") == 0).alias("right"))
    return J.change_classes(before, after)


def field_outcomes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("field"), F.when(F.col("l_quantity") > 5, F.col("l_returnflag")).alias("gold"),
        F.when(F.col("l_tax") > 0.01, F.when(F.col("l_discount") > 0.05, F.lit("r.")).otherwise(F.col("l_returnflag"))).alias("predicted")
    )
    return J.field_outcomes(li)


def _claims(spark, sf_dir):
    """Turns as gold claims, and as found: without the second of each conversation, with another text in the fourth, another role in the third."""
    c = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    gold = c.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("ix"), "text", "role", F.when(F.col("turn") < 3, F.col("turn")).alias("place"))
    found = gold.filter("ix != 1").select(
        "case_id", "ix", F.when(F.col("ix") == 3, "?").otherwise(F.col("text")).alias("text"), F.when(F.col("ix") == 2, "x").otherwise(F.col("role")).alias("role"),
        F.left("text", F.lit(9)).alias("role_text"), (F.col("ix") % 4).alias("place"), F.lit("?").alias("place_text"))
    return gold, found


def aligned_claims(spark, sf_dir):
    gold, found = _claims(spark, sf_dir)
    m = J.claim_metrics(gold, found, gold.select("case_id").distinct())
    return m.select(*[F.round(c, 9).alias(c) if c.endswith("accuracy") else c for c in m.columns])


def claim_field_scores(spark, sf_dir):
    """Scores of fields with claims numbered over all conversations, and within each."""
    gold, found = _claims(spark, sf_dir)
    both = [J.field_scores(gold, found, ["role", "place"], own).withColumn("per_case", F.lit(own)) for own in (False, True)]
    m = both[0].unionByName(both[1])
    return m.select("per_case", "field", "support_n", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "value_accuracy", "span_accuracy")])


_ALL = (
    page_notices, page_links, discovered_links, page_text, listing_gate, source_upsert, source_missing, source_health, health_log, dataset_fingerprint, annotation_violations, review_batch, promote_drafts, gold_pack, field_support, rule_obligations, ground_quotes,
    payload_errors, ground_kinds, confusion, accuracy, atom_prf, retrieval_metrics, mutations, leakage, contained_passages, price_percentiles, change_classes, field_outcomes, aligned_claims, claim_field_scores,
)
QUERIES = {f.__name__: f for f in _ALL}
_FOLD = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
#: ``norm_text`` of a value that is not null; the class is that of Unicode white space.
_NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[.,;:()]', '', 'g'), '[\x{{9}}-\x{{D}}\x{{85}}\p{{Z}}]+', ' ', 'g'))".format
SQL = {
    "page_notices": r"""
WITH p AS (SELECT page_id, html, make_timestamp(2026, page_id % 12 + 1, page_id % 28 + 1, page_id % 24, page_id % 60, 0) - INTERVAL 7 HOUR AS utc, len(regexp_extract_all(html, '<a [^>]*href=')) AS own,
  replace(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')), '&amp;', '&') AS name FROM pages)
SELECT page_id, 'Tin ' || page_id AS title, strftime(utc, '%Y-%m-%d %H:%M') AS published_utc,
  CASE WHEN page_id % 3 = 1 THEN 'Thông báo số ' || page_id || ' gửi sinh viên.' || chr(10) || 'Sinh viên xem tệp.' ELSE 'Tin ' || page_id || CASE WHEN page_id % 2 = 0 THEN ' Hot' ELSE '' END END AS raw_text,
  CASE WHEN page_id % 3 = 1 THEN 'body' ELSE 'title_only' END AS parse_mode, (own + 2)::BIGINT AS links, '/f/' || page_id || '.PDF?x=1 /f' || page_id AS attachments FROM p WHERE page_id % 3 <> 0
UNION ALL SELECT page_id, md5(name), NULL, 'true', 'title_only', own, '' FROM p WHERE page_id % 3 = 0""",
    "discovered_links": """
SELECT page_id, 'https://notices.example/Thongbao/id/' || page_id AS link, page_id::VARCHAR AS external_id, 1::BIGINT AS position FROM pages
UNION ALL SELECT page_id, 'https://notices.example/thongbao/ID/7' || page_id, '7' || page_id, 2 FROM pages""",
    "listing_gate": """
WITH p AS (SELECT *, contains(lower(html), CASE WHEN page_id % 2 = 0 THEN '<article>' ELSE '<nav>' END) AS ok FROM pages)
SELECT page_id % 5 AS source_id, url, CASE WHEN ok THEN 'parsed' ELSE 'listing' END AS stage, CASE WHEN NOT ok THEN 'MARKER_MISSING' END AS error_type, CASE WHEN NOT ok THEN 'expected marker absent' END AS message, CASE WHEN NOT ok THEN '2026-01-01' END AS failed_at FROM p""",
    "page_links": r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)))::BIGINT AS links FROM pages WHERE html LIKE '%<a %'""",
    "page_text": r"""
WITH p AS (SELECT page_id, replace(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')), '&amp;', '&') AS title,
  regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(script|style|noscript|template)[^>]*>.*?</(script|style|noscript|template)>', ' ', 'gs') AS h FROM pages),
t AS (SELECT page_id, title, replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM p),
v AS (SELECT page_id, title, trim(title || ' ' || trim(regexp_replace(t, '\s+', ' ', 'g'))) AS t FROM t)
SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN title END AS title, md5(CASE WHEN page_id % 9 <> 0 THEN t[1:24000] ELSE '' END) AS text_md5, CASE WHEN page_id % 9 = 0 THEN 'UNSUPPORTED_CONTENT_TYPE' WHEN length(t) > 24000 THEN 'CONTENT_TRUNCATED' ELSE 'OK' END AS status FROM v""",
    "source_upsert": """
WITH d AS (SELECT s_suppkey + CASE WHEN s_suppkey % 4 = 0 THEN 1000000 ELSE 0 END AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' ELSE s_name END AS name FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(s_suppkey, d.id) AS source_id, coalesce(d.name, s_name) AS name, CASE WHEN s_suppkey IS NULL OR d.name <> s_name THEN '2026' ELSE '2020' END AS updated_at FROM supplier FULL JOIN d ON s_suppkey = d.id""",
    "source_missing": "SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'seed' ELSE s_name END AS name FROM supplier",
    "source_health": """
WITH h AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'click' THEN 'FAILED' WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'DEGRADED' WHEN 1 THEN 'DEGRADED' ELSE 'FAILED' END
  WHEN event_id % 11 = 0 OR value * 10 < 500 OR event_id % 13 = 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM events)
SELECT user_id AS source_id, arg_max(health, (ts, event_id)) AS health_status, max(ts) AS last_checked_at, max(ts) FILTER (WHERE health = 'HEALTHY') AS last_success_at FROM h GROUP BY 1""",
    "health_log": "SELECT user_id AS source_id, ts AS checked_at, event_id AS check_id, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'HEALTHY' END AS health FROM events",
    "dataset_fingerprint": """
WITH r AS (SELECT md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, '\\N'), coalesce(text, '\\N'), coalesce(lang, '\\N'), coalesce(source, '\\N'), coalesce(n_chars::VARCHAR, '\\N'))) AS h FROM documents)
SELECT count(*) AS rows, sum(('0x' || h[1:15])::BIGINT::HUGEINT)::VARCHAR AS digest FROM r""",
    "annotation_violations": """
WITH o AS (SELECT *, 'e' || (o_orderkey % 2) AS e FROM orders), v AS (
  SELECT l_orderkey AS notice_id, 'unknown evidence_id' AS rule, 'e' || (l_linenumber % 2) AS item FROM lineitem LEFT JOIN o ON o_orderkey = l_orderkey WHERE e IS NULL OR e <> 'e' || (l_linenumber % 2)
  UNION ALL SELECT o_orderkey, 'text does not match offsets', e FROM o WHERE o_orderkey % 17 = 0 AND o_orderkey % 29 <> 0
  UNION ALL SELECT o_orderkey, 'one offset only', e FROM o WHERE o_orderkey % 29 = 0
  UNION ALL SELECT o_orderkey, 'evidence_id is not unique', e FROM o WHERE o_orderkey % 31 = 0
  UNION ALL SELECT o_orderkey, 'obligation_id is not unique', (o_custkey % 3)::VARCHAR FROM o WHERE o_orderkey % 37 = 0
  UNION ALL SELECT o_orderkey, 'deadline is no date', (o_custkey % 3)::VARCHAR FROM orders WHERE o_orderkey % 19 = 0 AND o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'deadline is no time', (o_custkey % 3)::VARCHAR FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'amount is negative', (o_custkey % 3)::VARCHAR FROM orders WHERE o_orderkey % 23 = 0
  UNION ALL SELECT o_orderkey, 'event ends before it starts', (o_custkey % 3)::VARCHAR FROM orders WHERE o_orderkey % 41 = 0
  UNION ALL SELECT l_orderkey, 'relation to itself', l_suppkey::VARCHAR FROM lineitem WHERE l_orderkey = l_suppkey)
SELECT DISTINCT notice_id, rule, item FROM v""",
    "review_batch": """
WITH s AS (SELECT doc_id, source, (contains(lower(text), 'the ')::INT + contains(lower(text), 'licen')::INT + contains(lower(text), 'rights')::INT + contains(lower(text), 'of ')::INT + contains(lower(text), 'und ')::INT)::BIGINT AS score FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id DESC) <= CASE source WHEN 'src1' THEN 4 WHEN 'src2' THEN 3 WHEN 'src3' THEN 3 ELSE 0 END AS q FROM s)
SELECT doc_id AS notice_id, source AS source_id, score FROM r ORDER BY q DESC, score DESC, doc_id DESC LIMIT 10""",
    "promote_drafts": "SELECT o_orderkey AS notice_id, CASE WHEN o_orderkey % 3 = 0 THEN 'GOLD' ELSE 'REVIEWED' END AS annotation_status FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 2 = 0 AND o_orderstatus = 'F' AND o_custkey % 2 = 0)",
    "gold_pack": "SELECT o_orderkey AS notice_id, l_linenumber::BIGINT AS obligation_id, CASE WHEN l_orderkey IS NULL THEN 'candidate' ELSE 'accepted' END AS state FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey",
    "field_support": "SELECT o_orderpriority, count(*) AS obligations, count(*) FILTER (WHERE o_orderstatus = 'F') AS with_deadline, count(*) FILTER (WHERE o_totalprice > 100000) AS with_amount FROM orders GROUP BY 1",
    "rule_obligations": """
SELECT o_orderkey AS notice_id, 0::BIGINT AS ordinal, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'chính quy' END AS programs, CASE WHEN o_orderkey % 2 = 0 THEN 'pay' ELSE 'register' END AS action_type, CASE WHEN o_orderkey % 2 = 0 THEN 'nộp học phí' ELSE 'đăng ký' END AS action_text,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT17:30:00+07:00') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deadline,
  CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 900 + 100) * 1000 END AS amount_vnd, CASE WHEN o_orderkey % 2 = 0 THEN 'Phòng A' || (o_orderkey % 9) END AS location,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'CCCD|bảng điểm' END AS documents, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'K21' END AS cohorts, o_orderkey % 2 = 0 AS for_all FROM orders
UNION ALL SELECT o_orderkey, n, '', kind, verb, CASE WHEN n = 1 THEN strftime(o_orderdate, '%Y-%m-%dT17:30:00+07:00') END, NULL, CASE WHEN n = 1 THEN 'Phòng A' || (o_orderkey % 9) END, '', '', true
FROM orders, (VALUES (1, 'submit', 'nộp'), (2, 'check', 'Kiểm tra')) t(n, kind, verb) WHERE o_orderkey % 2 = 0""",
    "ground_quotes": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), f AS (SELECT doc_id, ls[1] AS first FROM d)
SELECT doc_id AS quote_id, CASE WHEN doc_id % 4 = 0 THEN md5(first) WHEN doc_id % 4 = 1 THEN md5(trim(first)) END AS grounded_md5 FROM f WHERE doc_id % 4 <> 2
UNION ALL SELECT doc_id, md5(CASE WHEN length(first) BETWEEN 20 AND 150 THEN trim(first) ELSE first END) FROM f WHERE doc_id % 4 = 2""",
    "ground_kinds": """
SELECT o_orderkey AS quote_id, CASE o_orderkey % 6 WHEN 0 THEN 'nộp học phí' WHEN 2 THEN 'Thông báo số ' || o_orderkey || '.' WHEN 4 THEN NULL WHEN 5 THEN 'Sinh viên nộp học phí'
  ELSE 'Sinh viên nộp học phí' || chr(10) || 'trước ngày ' || strftime(o_orderdate, '%d/%m/%Y') || '.' END AS grounded FROM orders""",
    "payload_errors": """
SELECT o_orderkey AS output_id, CASE o_orderkey % 14 WHEN 1 THEN 'UNGROUNDED_CLAIM' WHEN 2 THEN 'INVALID_ACTION' WHEN 3 THEN 'INVENTED_YEAR' WHEN 4 THEN 'INVALID_AMOUNT' WHEN 5 THEN 'UNGROUNDED_FIELD'
  WHEN 6 THEN 'TRUST_VERDICT_OR_INVALID_CLAIM' WHEN 7 THEN 'INVALID_TOP_LEVEL_SCHEMA' WHEN 8 THEN 'INVALID_TOP_LEVEL_SCHEMA' WHEN 9 THEN 'INVALID_AMOUNT' WHEN 11 THEN 'INVALID_ACTION'
  WHEN 12 THEN 'TRUST_VERDICT_OR_INVALID_CLAIM' WHEN 13 THEN 'UNGROUNDED_FIELD' END AS error FROM orders""",
    "confusion": """
WITH d(label) AS (VALUES (0), (1), (2)), c AS (SELECT label, count(*) FILTER (WHERE quality = label AND toxic = label) AS tp, count(*) FILTER (WHERE quality <> label AND toxic = label) AS fp, count(*) FILTER (WHERE quality = label AND toxic <> label) AS fn FROM d, labels GROUP BY 1),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
SELECT label::BIGINT AS label, (tp + fn)::BIGINT AS support, CASE WHEN tp + fn > 0 THEN round(p, 9) END AS precision, CASE WHEN tp + fn > 0 THEN round(r, 9) END AS recall, CASE WHEN tp + fn > 0 THEN round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) END AS f1 FROM s""",
    "accuracy": "SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS right, round(count(*) FILTER (WHERE quality = toxic) / count(*), 9) AS accuracy FROM labels",
    "atom_prf": """
WITH g AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS field, l_linenumber::VARCHAR AS atom, true AS g FROM lineitem),
p AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS field, (l_partkey % 5)::VARCHAR AS atom, true AS p FROM lineitem),
c AS (SELECT field, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM g FULL JOIN p USING (id, field, atom) GROUP BY 1),
s AS (SELECT *, tp / (tp + fp) AS pr, tp / (tp + fn) AS re FROM c)
SELECT field, tp, fp, fn, round(pr, 9) AS precision, round(re, 9) AS recall, round(2 * pr * re / (pr + re), 9) AS f1 FROM s""",
    "retrieval_metrics": """
WITH q AS (SELECT vec_id AS query_id, label AS own FROM embeddings WHERE vec_id % 50 = 0),
f AS (SELECT query_id, min(vec_id % 10 + 1) AS first, count(*) FILTER (WHERE vec_id % 10 + 1 <= 1) AS a, count(*) FILTER (WHERE vec_id % 10 + 1 <= 3) AS b, count(*) FILTER (WHERE vec_id % 10 + 1 <= 5) AS c FROM q JOIN embeddings ON label = own AND vec_id >= query_id AND vec_id < query_id + 10 GROUP BY 1),
t AS (SELECT query_id, count(*) AS n FROM q JOIN embeddings ON label = own GROUP BY 1)
SELECT count(*) AS queries, round(avg((coalesce(first, 99) <= 1)::INT), 9) AS hit_1, round(avg((coalesce(first, 99) <= 3)::INT), 9) AS hit_3, round(avg((coalesce(first, 99) <= 5)::INT), 9) AS hit_5,
  round(avg(coalesce(a / n, 0)), 9) AS recall_1, round(avg(coalesce(b / n, 0)), 9) AS recall_3, round(avg(coalesce(c / n, 0)), 9) AS recall_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr FROM q LEFT JOIN f USING (query_id) LEFT JOIN t USING (query_id)""",
    "mutations": """
SELECT o_orderkey AS case_id, m AS mutation, CASE m WHEN 'deadline' THEN strftime(o_orderdate + INTERVAL 4 DAY, '%Y-%m-%d') WHEN 'unsupported' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deadline,
  CASE m WHEN 'location' THEN 'another place' WHEN 'unsupported' THEN NULL ELSE o_orderpriority END AS location, CASE m WHEN 'exact' THEN 'VERIFIED' WHEN 'deadline' THEN 'CONFLICT' WHEN 'location' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'ABSTAINED' END AS expected
FROM orders, (VALUES ('exact'), ('deadline'), ('location'), ('unsupported')) t(m)""",
    "leakage": f"SELECT doc_id AS case_id FROM documents WHERE {_FOLD} IN (SELECT {_FOLD} FROM documents WHERE source = 'src0')",
    "contained_passages": f"WITH d AS (SELECT doc_id, {_FOLD} AS t FROM documents), p AS (SELECT item_id, {_FOLD} AS p FROM benchmark) SELECT item_id, doc_id FROM p JOIN d ON contains(' ' || t || ' ', ' ' || p || ' ')",
    "price_percentiles": "WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT count(*) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95, max(v) FILTER (WHERE i = floor(n * 0.95)) AS p95_at FROM s",
    "change_classes": "SELECT doc_id AS case_id, CASE WHEN quality = 1 AND toxic <> 0 THEN 'regression' WHEN quality <> 1 AND toxic = 0 THEN 'fixed' WHEN toxic = 0 THEN 'unchanged' ELSE 'limitation' END AS change FROM labels",
    "field_outcomes": f"""
WITH r AS (SELECT l_linestatus AS field, CASE WHEN l_quantity > 5 THEN l_returnflag END AS g, CASE WHEN l_tax > 0.01 THEN CASE WHEN l_discount > 0.05 THEN 'r.' ELSE l_returnflag END END AS p FROM lineitem)
SELECT field, CASE WHEN g IS NULL AND p IS NULL THEN 'absent' WHEN g IS NULL THEN 'hallucinated' WHEN p IS NULL THEN 'missing' WHEN {_NORM('g')} = {_NORM('p')} THEN 'correct' ELSE 'incorrect' END AS outcome, count(*) AS n FROM r GROUP BY 1, 2""",
    "aligned_claims": """
WITH g AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT conv_id, CASE WHEN turn = 3 THEN '?' ELSE text END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn <> 1),
c AS (
  SELECT conv_id, count(g.n) AS g, (SELECT count(*) FROM p WHERE p.conv_id = g.conv_id) AS p, (SELECT count(*) FROM g a JOIN p b ON a.conv_id = b.conv_id AND a.n = b.n AND a.text = b.text WHERE a.conv_id = g.conv_id) AS same FROM g GROUP BY 1)
SELECT count(*) AS n, round(count(*) FILTER (WHERE g = p) / count(*), 9) AS claim_count_accuracy, round(count(*) FILTER (WHERE g = p AND same = g) / count(*), 9) AS claim_boundary_accuracy,
  greatest(sum(g) - sum(p), 0)::BIGINT AS missed_claims, greatest(sum(p) - sum(g), 0)::BIGINT AS hallucinated_claims FROM c""",
    "claim_field_scores": """
WITH t AS (SELECT conv_id AS c, turn AS ix, text, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
g AS (SELECT *, row_number() OVER (ORDER BY c, ix) AS i, row_number() OVER (PARTITION BY c ORDER BY ix) AS n FROM t),
p AS (SELECT *, row_number() OVER (ORDER BY c, ix) AS i, row_number() OVER (PARTITION BY c ORDER BY ix) AS n FROM t WHERE ix <> 1),
j AS (
  SELECT false AS own, g.text AS whole, g.role AS gr, CASE WHEN g.ix < 3 THEN g.ix END AS gp, CASE WHEN p.ix = 2 THEN 'x' ELSE p.role END AS pr, p.ix % 4 AS pp, p.text[1:9] AS held FROM g LEFT JOIN p ON g.i = p.i
  UNION ALL SELECT true, g.text, g.role, CASE WHEN g.ix < 3 THEN g.ix END, CASE WHEN p.ix = 2 THEN 'x' ELSE p.role END, p.ix % 4, p.text[1:9] FROM g LEFT JOIN p ON g.c = p.c AND g.n = p.n),
f AS (SELECT own, 'role' AS field, gr AS w, pr AS o, contains(whole, held) AS h FROM j UNION ALL SELECT own, 'place', gp::VARCHAR, pp::VARCHAR, contains(whole, CASE WHEN pp IS NOT NULL THEN '?' END) FROM j),
c AS (
  SELECT own, field, count(w) AS s, count(*) FILTER (WHERE w = o) AS tp, count(*) FILTER (WHERE w IS NOT NULL AND (w = o) IS NOT TRUE) AS fn, count(*) FILTER (WHERE w IS NULL AND o IS NOT NULL) AS fp, count(*) FILTER (WHERE w = o AND h) AS sp FROM f GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS re FROM c)
SELECT own AS per_case, field, s AS support_n, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr > 0 AND re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f1,
  round(CASE WHEN s > 0 THEN tp / s END, 9) AS value_accuracy, round(CASE WHEN s > 0 THEN sp / s END, 9) AS span_accuracy FROM r""",
}
