from pyspark.sql import functions as F

from herald.functions import text as T
from herald.operators import claims as C
from herald.operators import obligations as O
from herald.operators import verify as V

MESSAGES = [
    (1, "Sinh viên K21 đăng ký học phần trước ngày 15/08/2026, nộp lệ phí 450.000 đồng tại Phòng A1.  Xem kết quả!"),
    (2, "😀 Đóng học phí 250k\nhạn cuối: 30/9\n\nHồ sơ gồm CCCD, cccd và bảng điểm, trừ sinh viên K20"),
    (3, None), (4, "đóng góp ý kiến và nộp đơn"), (5, "  \n \n"), (6, "Hôm nay trời đẹp. Không có gì!"),
]


def _claims(spark):
    m = spark.createDataFrame(MESSAGES, "message_id long, text string")
    return {(r.message_id, r.claim_ix): r for r in C.extract_claims(m).collect()}


def test_spans_are_exact_and_blocks_split(spark):
    texts, rows = dict(MESSAGES), _claims(spark)
    assert set(rows) == {(1, 0), (1, 1), (2, 0), (2, 1), (4, 0), (4, 1), (6, 0), (6, 1)}
    for (m, _), r in rows.items():
        assert texts[m][r.start_char:r.end_char] == r.text
        for f in (r.action, r.deadline, r.amount, r.audience, r.location):
            assert f is None or r.text[f.start:f.start + len(f.text)] == f.text


def test_fields(spark):
    rows = _claims(spark)
    a = rows[1, 0]
    assert (
        a.action.type, a.deadline.normalized, a.amount.value, a.audience.cohort, a.location.normalized, a.object_hint
    ) == ("register", "2026-08-15", 450000, "K21", "Phòng A1", "học phần")
    b = rows[2, 0]
    assert (b.action.type, b.deadline.text, b.deadline.normalized, b.amount.value) == ("pay", "30/9", None, 250000)
    assert rows[2, 1].documents == ["CCCD", "bảng điểm"] and rows[2, 1].exceptions == ["trừ sinh viên K20"]
    assert rows[4, 0].action is None and rows[4, 1].action.type == "submit"
    assert all(rows[6, i].action is None for i in (0, 1))


def test_values(spark):
    texts = ["đến 17h30 ngày 5/6/2026", "31/02/2026", "từ 01/01/2026 đến 2-3-2026", "không", None, "25:10 1/1/2026"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.parse_deadline("t").alias("d"))
    got = [(r.d.normalized, r.d.precision) for r in df.orderBy("i").collect()]
    assert got == [
        ("2026-06-05T17:30:00+07:00", "datetime"), (None, "unknown"), ("2026-03-02", "date"), (None, "unknown"), (None, "unknown"),
        (None, "unknown")
    ]
    money = spark.createDataFrame(
        [("50 k",), ("1,5 triệu đồng",), ("450.000 VND",), ("nhiều tiền",)], "t string"
    ).select(T.parse_vnd("t").alias("v"))
    assert [r.v for r in money.collect()] == [50000, 1500000, 450000, None]


def test_verdicts(spark):
    claims = [
        ("submit", "nộp", "1/1/2026", "2026-01-01", None, None), ("submit", "nộp", "2/1/2026", "2026-01-02", None, None),
        ("submit", "nộp", "1/1", None, None, None), ("pay", "đóng", None, None, "5 k", 5000), ("pay", "đóng", None, None, None, None),
        (None, None, None, None, None, None)
    ]
    schema = "action struct<type:string,text:string>, deadline struct<text:string,normalized:string>, amount struct<text:string,value:bigint>"
    rows = [
        (i, 0, i % 5, 1, (a, t) if a else None, (d, n) if d else None, (m, v) if m else None) for i, (a, t, d, n, m, v) in enumerate(claims)
    ]
    c = spark.createDataFrame(rows, f"message_id int, claim_ix int, notice_id int, version_id int, {schema}")
    o = spark.createDataFrame([(0, 1, 0, "submit", None, "2026-01-01", None), (1, 1, 0, "submit", None, "2026-01-01T10:00:00+07:00", None), (2, 1, 0, "submit", None, "2026-01-01", None), (3, 1, 0, "pay", None, None, 6000), (4, 1, 0, "pay", None, None, 1), (4, 1, 1, "pay", None, "2026-01-01", 2)],
                              "notice_id int, version_id int, ordinal int, off_action string, off_deadline string, off_deadline_norm string, off_amount bigint")
    v = V.verify_claims(c, o, spark.createDataFrame([(0, 1, "SUPERSEDED_OUTDATED")], "notice_id int, version_id int, validity string"))
    got = {r.message_id: (r.verdict, r.abstention_reason) for r in v.collect()}
    assert got[0] == ("PARTIALLY_VERIFIED", None)  # verified, but by an outdated notice
    assert got[1] == ("CONFLICT", None) and got[2] == ("PARTIALLY_VERIFIED", None) and got[3] == ("CONFLICT", None)
    assert got[4] == ("VERIFIED", None)  # equal ties are no ambiguity
    assert got[5] == ("ABSTAINED", "UNSUPPORTED_CLAIM_FIELD")


def test_ambiguous_tie(spark):
    c = spark.createDataFrame(
        [(1, 0, 1, 1, ("pay", "đóng"), None, ("5 k", 5000))],
        "message_id int, claim_ix int, notice_id int, version_id int, action struct<type:string,text:string>, deadline struct<text:string,normalized:string>, amount struct<text:string,value:bigint>"
    )
    o = spark.createDataFrame(
        [(1, 1, i, "pay", None, None, a) for i, a in enumerate((1, 2))],
        "notice_id int, version_id int, ordinal int, off_action string, off_deadline string, off_deadline_norm string, off_amount bigint"
    )
    r = V.verify_claims(c, o, spark.createDataFrame([], "notice_id int, version_id int, validity string")).first()
    assert r.abstention_reason == "AMBIGUOUS_OFFICIAL_EVIDENCE"


def test_grounding(spark):
    q = spark.createDataFrame(
        [
            (1, "nộp  hồ sơ", "Hãy nộp hồ sơ.\nNộp Hồ sơ"), (2, "abc", None),
            (3, "nộp hồ sơ ngay hôm nay nhé", "nộp hồ sơ ngay hôm nay nhe\nkhác"), (4, "xyz", "abc"), (5, "abc", "xabcx")
        ],
        "quote_id long, quote string, raw_text string"
    )
    assert {r.quote_id: r.grounded for r in O.ground(q).collect()} == {
        1: "Nộp Hồ sơ", 2: None, 3: "nộp hồ sơ ngay hôm nay nhe", 4: None, 5: "abc"
    }


def test_dates_in_text(spark):
    r = spark.createDataFrame([("1/2/2026 và 31/2/2026, 2026-03-04",)], "t string").select(T.dates_in("t").alias("d")).first()
    assert r.d == ["2026-02-01", "2026-03-04"]
    assert spark.range(1).select(F.size(T.segments(F.lit("a. b\nc"))).alias("n")).first().n == 4
