"""Grounding of quotes and actions, drafts, checks of model outputs, qualification."""

import json
import random
import re
import unicodedata
from difflib import SequenceMatcher

import duckdb
from pyspark.sql import functions as F

from herald.operators import evaluate as J
from herald.operators import obligations as O
from herald.plans import quality as Q

TEXT = "Thông báo\nSinh viên Làm   thủ tục ở phòng một cửa.\nSinh viên nộp học phí\ntrước ngày 10. Liên hệ – phòng A → B"


def by_hand(quote, text):
    def fold(x):
        x = unicodedata.normalize("NFC", x).replace("–", "-").replace("—", "-").replace("→", "->")
        return re.sub(r"\s+", " ", x).strip().casefold()

    if quote in text:
        return quote
    if not fold(quote):
        return None
    parts = [x.strip() for x in text.splitlines()] + [x.strip() for x in re.split(r"(?<=[.;!?])\s+", text)]
    best, score = None, 0.0
    for p in [p for p in dict.fromkeys(parts) if p]:
        a, b = fold(quote), fold(p)
        if a == b:
            return p
        s = SequenceMatcher(None, a, b).ratio()
        if a in b or b in a:
            s = max(s, min(len(a), len(b)) / max(len(a), len(b)))
        if s > score:
            best, score = p, s
    return best if score >= 0.88 else None


def test_quotes(spark):
    random.seed(3)
    quotes = [
        "sinh viên làm thủ tục ở phòng một cửa.", "Sinh viên nộp học phí trước ngày 10.", unicodedata.normalize("NFD", "Sinh viên nộp học phí"),
        "liên hệ - phòng a -> b", "Sinh viên nộp học phi trước ngày 11.", "phòng một", "không có", "", "  ", None]
    rows = [(i, q, TEXT) for i, q in enumerate(quotes)] + [(50, "x", None)]
    words = ["nộp", "đơn.", "hạn", "phí;", "lớp", "học!", "\n", "  "]
    for i in range(300):
        text = " ".join(random.choices(words, k=25))
        a, b = sorted(random.sample(range(len(text)), 2))
        quote = text[a:b].replace("\n", " ")
        if random.random() < 0.6 and quote:
            at = random.randrange(len(quote))
            quote = quote[:at] + random.choice("xyz  ") + quote[at + 1 :]
        rows.append((100 + i, random.choice([quote, unicodedata.normalize("NFD", quote), quote.upper()]), text))
    got = {r.quote_id: r.grounded for r in O.ground(spark.createDataFrame(rows, "quote_id long, quote string, raw_text string")).collect()}
    want = {i: None if q is None or t is None else by_hand(q, t) for i, q, t in rows}
    assert got == want and sum(v is not None for v in want.values()) > 50
    assert got[1] == "Sinh viên nộp học phí\ntrước ngày 10." and got[2] == "Sinh viên nộp học phí"


def test_actions(spark):
    rows = [
        (1, "sinh viên làm thủ tục ở phòng một cửa.", "other", TEXT), (2, "gì đó khác hẳn", "pay", "Dòng\n  Đóng học\nphí ngay \nhết"),
        (3, "gì đó khác hẳn", "attend", TEXT), (4, "gì đó khác hẳn", "unknown", "tham gia")]
    got = {r.action_id: r.grounded for r in O.ground_actions(spark.createDataFrame(rows, "action_id long, quote string, action_type string, raw_text string")).collect()}
    assert got == {1: "Sinh viên Làm   thủ tục ở phòng một cửa.", 2: "Đóng học\nphí ngay", 3: None, 4: None}


def test_drafts_of_few_columns(spark):
    rows = [(1, 7, 1, TEXT, "pay", "nộp  học phí"), (2, 7, 1, TEXT, "pay", "xyz xyz"), (3, 7, 1, TEXT, "pay", "Sinh viên nộp học phí trước ngày 10.")]
    d = spark.createDataFrame(rows, "draft_id long, notice_id long, version_id long, raw_text string, action_type string, action_quote string")
    found = O.draft_obligations(d)
    line, sentence = "Sinh viên nộp học phí", "Sinh viên nộp học phí\ntrước ngày 10."
    assert [(r.obligation_id, r.draft_id, r.action_text, r.documents, r.deadline) for r in found.orderBy("draft_id").collect()] == [
        ("o1", 1, line, [], None), ("o2", 2, line, [], None), ("o3", 3, sentence, [], None)]
    e = O.draft_evidence(found).orderBy("evidence_id").collect()
    assert [(r.evidence_id, r.field, TEXT[r.start_char : r.end_char]) for r in e] == [("e1", "action", line), ("e2", "action", sentence)]


def test_outputs_claim_by_claim(spark):
    message = "Sinh viên nộp đơn trước 30/9/2026, phí 50000"
    ok = {"claim_text": "nộp đơn", "action": "nộp", "action_normalized": "submit"}
    cases = [
        ([ok, ok], None), ([{**ok, "amount_value": "5"}], "INVALID_AMOUNT"), ([{**ok, "amount_value": 5}], None), ([{**ok, "amount_value": 5.5}], "INVALID_AMOUNT"),
        ([{**ok, "verdict": None}], "TRUST_VERDICT_OR_INVALID_CLAIM"), ([{**ok, "action_normalized": "fly"}, {**ok, "verdict": "x"}], "INVALID_ACTION"),
        ([ok, {**ok, "claim_text": ""}], "UNGROUNDED_CLAIM"), ([{**ok, "deadline_normalized": ""}], None),
        ([{**ok, "deadline_normalized": "2026-09-30", "deadline_raw": "30/9"}], "INVENTED_YEAR"), (["text"], "TRUST_VERDICT_OR_INVALID_CLAIM"),
        ([{**ok, "required_documents": ["đơn", None]}], None), ([{**ok, "required_documents": ["thẻ"]}], "UNGROUNDED_FIELD"), ([], None)]
    rows = [(i, message, json.dumps({"claims": c})) for i, (c, _) in enumerate(cases)]
    rows += [(90, message, None), (91, message, "{"), (92, message, '{"claims":{}}'), (93, message, '{"claims":[],"x":1}'), (94, message, "[]")]
    got = {r.output_id: r.error for r in O.payload_errors(spark.createDataFrame(rows, "output_id long, message string, payload string")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)} | {i: "INVALID_TOP_LEVEL_SCHEMA" for i in range(90, 95)}


def test_policy(spark):
    schema = "case_id long, ix long, action string, deadline string, amount long, audience string, required_documents array<string>"
    gold = [(1, i, "pay", None, 5, "K21", ["Đơn  xin", "thẻ", "thẻ"]) for i in range(9)]
    cases = spark.createDataFrame([(1, None), (2, None)], "case_id long, error string")
    g = spark.createDataFrame(gold, schema)
    same = spark.createDataFrame([(*r[:6], ["thẻ", "đơn XIN", "thẻ"]) for r in gold], schema)
    status = lambda c, r: J.qualification(c, g, r).first()
    assert status(cases, same).status == "QUALIFIED_FOR_EVALUATED_FIELDS_ONLY"
    one = spark.createDataFrame([*gold[:8], (1, 8, "pay", "2026-01-01", 5, "k21", ["thẻ"])], schema)
    r = status(cases, one)  # one invented and one wrong field are for review, not blocked
    assert (r.status, r.field_mismatches) == ("MEASURED_REQUIRES_HUMAN_REVIEW", 3)
    assert status(cases, same.limit(8)).missing_claims == 1
    failed = cases.withColumn("error", F.when(F.col("case_id") == 2, "INVENTED_YEAR"))
    assert status(failed, same).status == "QUALIFICATION_BLOCKED"


def test_values_named_twice(spark):
    e = spark.createDataFrame([(1, "a", "x"), (2, "a", None)], "record_id long, field string, value string")
    p = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "y")], "record_id long, field string, value string")
    r = J.value_metrics(e, p).first()
    assert (r.support_n, r.matched_n, r.predicted_value_n, r.precision, r.recall) == (1, 1, 3, 1 / 3, 1.0)


def test_empty_gold_list(spark):
    rows = [(1, "accepted", [], "one"), (2, "accepted", ["a", "b"], "one"), (3, "accepted", None, "one"), (4, "candidate", ["a"], "one")]
    r = spark.createDataFrame(rows, "record_id long, state string, gold_claims array<string>, gold_claim string")
    assert sorted((x.record_id, x.ix, x.claim) for x in J.expand_gold(r).collect()) == [(1, 0, "one"), (2, 0, "a"), (2, 1, "b"), (3, 0, "one")]


def test_running_sums_over_ranges(spark):
    rows = [(i, i % 7) for i in range(500)]
    got = J.running(spark.createDataFrame(rows, "a long, b long").repartition(5), ["a"], "b", "before").collect()
    assert {r.a: r.before for r in got} == {a: sum(b for _, b in rows[:a]) for a, _ in rows}


def test_outcomes_of_values_written_otherwise(spark):
    pairs = [("Đơn  xin.", "đơn xin"), ("(R)", "r"), ("x\u00a0y", "X\ty"), ("x", "y"), ("xy", "x y"), (None, "x"), ("x", None), (None, None), ("", ".")]
    rows = spark.createDataFrame([("f", *p) for p in pairs], "field string, gold string, predicted string")
    got = {r.outcome: r.n for r in J.field_outcomes(rows).collect()}
    assert got == {"correct": 4, "incorrect": 2, "hallucinated": 1, "missing": 1, "absent": 1}
    exact = {r.outcome: r.n for r in J.field_outcomes(rows, exact=True).collect()}
    assert exact == {"incorrect": 6, "hallucinated": 1, "missing": 1, "absent": 1}


def test_outcome_query_takes_other_spellings(spark, tmp_path):
    flags = ["R", "r.", " R ", "(R)", "R\u00a0", "R\u200b", "N", "", "Σ.", None]
    rows = [(status, flag, q, 0.06, tax) for status in ("O", None) for flag in flags for q in (1.0, 9.0) for tax in (0.0, 0.05)]
    schema = "l_linestatus string, l_returnflag string, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(((r.field or "", r.outcome, r.n) for r in Q.QUERIES["field_outcomes"](spark, str(tmp_path)).collect()))
    each = [("absent", 11), ("correct", 5), ("hallucinated", 11), ("incorrect", 4), ("missing", 9)]
    assert got == [(field, o, n) for field in ("", "O") for o, n in each]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted((f or "", o, n) for f, o, n in db.execute(Q.SQL["field_outcomes"]).fetchall()) == got


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quotes_are_read_once(spark):
    rows = [(1, "A  B", "x\na b"), (2, "à b", "x\nà b"), (3, "a \x1f b", "a \x1f b."), (4, "a \U0001e900\U0001e946", "a \U0001e922\U0001e946. b"), (5, None, "a"), (6, "a", None)]
    q = spark.createDataFrame(rows, "quote_id long, quote string, raw_text string")
    found = O.ground(q)
    assert _plan(found).count("LogicalRDD") == 1 and "Union" not in _plan(found)
    assert {r.quote_id: r.grounded for r in found.collect()} == {1: "a b", 2: "à b", 3: "a \x1f b", 4: "a \U0001e922\U0001e946.", 5: None, 6: None}


def test_drafts_stay_in_their_rows(spark):
    rows = [(1, 7, 1, TEXT, "pay", "nộp  học phí", ["phòng MỘT cửa", None, "", "Thông báo", "THÔNG  BÁO"], ["", "phòng A"]), (2, 7, 1, TEXT, "pay", "", [], None)]
    d = spark.createDataFrame(
        rows, "draft_id long, notice_id long, version_id long, raw_text string, action_type string, action_quote string, "
        "document_quotes array<string>, exception_quotes array<string>")
    found = O.draft_obligations(d)
    assert "Join" not in _plan(found) and _plan(found).count("LogicalRDD") == 1
    assert [(r.draft_id, r.action_text, r.documents, r.exceptions) for r in found.collect()] == [
        (1, "Sinh viên nộp học phí", ["Thông báo", "Thông báo"], ["phòng A"])]
    e = O.draft_evidence(found)
    assert [(r.evidence_id, r.field, r.text) for r in e.orderBy("evidence_id").collect()] == [
        ("e1", "action", "Sinh viên nộp học phí"), ("e2", "document", "Thông báo"), ("e3", "exception", "phòng A")]
