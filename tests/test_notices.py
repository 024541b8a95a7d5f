from datetime import datetime, timedelta

from pyspark.sql import functions as F

from herald.functions import urls as U
from herald.operators import feed as I
from herald.operators import monitoring as M
from herald.operators import retrieval as R
from herald.operators import versions as N
from herald.sources import pages, registry

T0 = datetime(2026, 1, 1)


def test_urls(spark):
    urls = ["HTTP://Notices.Example:80//a//b/?utm_x=1&b=2&a=1#f", "http://other.test:8080/", "https://notices.example?ref=1", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(U.normalize_url("u", "notices.example").alias("n"))
    assert [r.n for r in df.collect()] == [
        "https://notices.example:80/a/b?a=1&b=2", "http://other.test:8080/", "https://notices.example/", None
    ]
    bad = [
        "ftp://a.b", "http://user:x@a.b/", "http://localhost/", "http://10.0.0.1/", "http://8.8.8.8/", "https://a.b/c", "",
        "http://intranet/"
    ]
    got = spark.createDataFrame([(u,) for u in bad], "u string").select(U.admission("u").alias("a")).collect()
    assert [r.a for r in got] == ["INVALID_URL", "UNSAFE_URL", "UNSAFE_URL", "UNSAFE_URL", None, None, "INVALID_URL", "UNSAFE_URL"]


def _obs(spark, rows):
    return spark.createDataFrame(
        [(k, u, h, T0 + timedelta(hours=i), t, h) for i, (k, u, h, t) in enumerate(rows)],
        "notice_key string, normalized_url string, content_hash string, observed_at timestamp, title string, raw_text string"
    )


def test_changes_and_heads(spark):
    o = _obs(spark, [("n", "u", "a", "t"), ("n", "u", "a", "t"), ("n", "m", "z", "t"), ("n", "u", "b", "t"), ("n", "u", "a", "t")])
    c = N.classify_changes(o)
    assert [r.outcome for r in c.orderBy("observed_at").collect()] == ["CREATED", "UNCHANGED", "DUPLICATE", "UPDATED", "UPDATED"]
    v, h = N.versions(c), N.heads(c)
    assert v.count() == 2 and h.first().current_content_hash == "a"
    assert {r.content_hash: r.is_latest for r in N.current_versions(v, h).collect()} == {"a": True, "b": False}
    assert N.newest_versions(v, version_id="observed_at").first().content_hash == "b"  # content went back


def test_monitoring(spark):
    rows = [(1, T0 + timedelta(minutes=i), i, f) for i, f in enumerate([True, True, False, True])]
    c = spark.createDataFrame(
        rows, "source_id int, checked_at timestamp, check_id int, failed boolean"
    ).withColumns({"changed": ~F.col("failed"), "error": F.lit("x"), "outcome": F.lit("o")})
    got = [(r.consecutive_failures, r.delay_seconds) for r in M.failure_streaks(c).orderBy("check_id").collect()]
    assert got == [(1, 1200), (2, 2400), (0, 600), (1, 1200)]
    e = spark.createDataFrame(
        [(1, 1, "NEW", T0), (1, 2, "UPDATED", T0 - timedelta(hours=60)), (2, 3, "NEW", T0)],
        "notice_id int, event_id int, outcome string, observed_at timestamp"
    )
    assert [r.notice_id for r in M.latest_activity(e, F.lit(T0)).collect()] == [2]  # the latest event is too old for 1


def test_chunks(spark):
    text = "a" * 300 + "\n" + "b" * 250 + "\nc\n\n d \n  \n" + "e" * 501
    c = spark.createDataFrame([(1, text)], "version_id int, raw_text string")
    rows = R.chunk_versions(c).orderBy("ordinal").collect()
    assert all(text[r.start_char:r.end_char] == r.text for r in rows)
    assert [len(r.text) for r in rows] == [551, 1, 3, 501]


def test_fusion_uses_ranks_before_the_filter(spark):
    a = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate([10, 11, 12])], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate([12, 10])], "query_id int, doc_id int, rank int")
    assert [r.doc_id for r in R.rrf([a, b], 2).orderBy("rank").collect()] == [10, 12]
    cur = spark.createDataFrame([(11,), (12,)], "doc_id int")
    r = R.rrf_current([a, b], cur, 2).orderBy("rank").collect()
    assert [x.doc_id for x in r] == [12, 11] and abs(r[1].score - 1 / 62) < 1e-12


def test_actionability_boundaries(spark):
    def at(now, deadline, precision="date", start=None):
        lit = lambda x: F.lit(x).cast("string")
        return spark.range(1).select(
            I.actionability(
                lit(deadline), lit(precision), lit(start), lit("date"), lit(None), lit(None), F.lit(now).cast("timestamp")
            ).alias("a")
        ).first().a

    assert at("2026-03-15 16:59:59", "2026-03-15") == "ACTIVE" and at("2026-03-15 17:00:00", "2026-03-15") == "EXPIRED"
    assert at(
        "2026-03-15 10:00:00", "2026-03-15T17:00:00+07:00", "datetime"
    ) == "ACTIVE" and at("2026-03-15 10:00:01", "2026-03-15T17:00:00+07:00", "datetime") == "EXPIRED"
    assert at(
        "2026-03-01 00:00:00", "2026-03-15", start="2026-03-20"
    ) == "UNKNOWN" and at("2026-03-01 00:00:00", "2026-03-15", start="2026-03-10") == "UPCOMING"
    assert at("2026-03-01 00:00:00", None) == "NO_DEADLINE" and at("2026-03-01 00:00:00", "soon") == "UNKNOWN"


PAGE = """<html><head><title>Trang chủ</title><script>var a = "1";</script></head><body><h1>Old</h1>
<h2>Thông báo  học phí <b>Hot</b></h2><span>05/06/2026 08:30</span><p>Sinh viên nộp học phí trước ngày 1/7.</p><p>Sinh viên nộp học phí trước ngày 1/7.</p>
<script>x()</script><a href="/files/a.pdf">a</a><a href="a.PDF?x=1">b</a><a href="/Thongbao/id/12">n</a><iframe src="https://drive.google.com/f"></iframe><div>Các thông tin khác</div><p>no</p></body></html>"""


def test_notice_page(spark):
    df = spark.createDataFrame(
        [(1, "https://notices.example/x/y", PAGE), (2, "https://notices.example/z", None), (3, "u", "<p>x")],
        "page_id long, url string, html string"
    )
    rows = {r.page_id: r for r in pages.parse_notices(df).collect()}
    r = rows[1]
    assert r.title == "Thông báo học phí" and r.parse_mode == "body" and r.publication_date == datetime(2026, 6, 5, 1, 30)
    assert r.raw_text == "Sinh viên nộp học phí trước ngày 1/7.\na\nb\nn"
    assert r.attachments == ["https://notices.example/files/a.pdf", "https://notices.example/x/a.PDF?x=1", "https://drive.google.com/f"]
    assert (rows[2].title, rows[2].parse_mode) == ("Untitled notice", "title_only")
    links = pages.discover_links(pages.parse_notices(df), "notices.example").collect()
    assert [(x.page_id, x.external_id) for x in links] == [(1, "12")]


def test_registry(spark):
    s = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "source_id int, name string, updated_at string")
    seed = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "source_id int, name string")
    got = {r.source_id: (r.name, r.updated_at) for r in registry.upsert_sources(s, seed, F.lit("now"), ("name",)).collect()}
    assert got == {1: ("a", "old"), 2: (None, "now"), 3: ("c", "now")}
