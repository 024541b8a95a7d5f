"""Notices: obligations by rules, grounding of quotes, checks of model outputs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herald.functions.text import FLAGS, date_iso, dates_in, let, parse_deadline, parse_vnd, pieces, span_of, trim_space

# --- Fixed values: the wording that obligations are recognised by --------------
ACTIONS = [
    ("pay", r"(?:nộp|đóng|thanh toán)\s+(?:học\s*phí|lệ\s*phí|phí)"),
    ("register", r"đăng\s*k[ýí]"),
    ("apply", r"ứng\s*tuyển|đề\s+nghị\s+xét"),
    ("submit", r"\bnộp\b"),
    ("attend", r"tham\s+gia"),
    ("update", r"tự\s+đánh\s+giá|cập\s+nhật"),
    ("check", r"xem|kiểm\s+tra"),
    ("other", r"thực\s+hiện|hoàn\s+tất"),
]
ANCHORS = {
    "register": [r"đăng\s*k[ýí]"],
    "apply": [r"ứng\s*tuyển", r"nộp\s+đơn", r"đăng\s*k[ýí]\s+tham\s+gia"],
    "submit": [r"\bnộp\b", r"gửi\s+hồ\s+sơ"],
    "pay": [r"đóng\s+học\s*phí", r"nộp\s+học\s*phí", r"thanh\s+toán"],
    "attend": [r"tham\s+gia"],
    "collect": [r"nhận"],
    "update": [r"cập\s+nhật", r"tự\s+đánh\s+giá"],
    "check": [r"kiểm\s+tra", r"\bxem\b"],
    "other": [r"thực\s+hiện", r"hoàn\s+tất"],
}
DATE = r"\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{4}"
TIME = r"(?iuU)\d{1,2}\s*(?:h|:)\s*\d{2}"
MONEY = r"(?:\d{1,3}(?:[.\s]\d{3})+|\d+)\s*(?:đồng|VND|đ)(?!\w)"
LOCATION = r"(?:Địa\s*điểm\s*:?\s*|tại\s+)((?:Phòng|Khu|Ban|Trường)[^.;\n]{2,120})"
AUDIENCE = r"(?:(?:tất cả|các)\s+)?(?:em\s+)?sinh\s+viên[^.;\n]{0,180}"
DOCUMENTS = (
    r"CMND|CCCD|ảnh\s+thẻ[^.;\n]*|bảng\s+điểm[^.;\n]*|chứng\s+chỉ[^.;\n]*|sơ\s+yếu\s+lý\s+lịch[^.;\n]*|"
    r"thư\s+tự\s+giới\s+thiệu[^.;\n]*|bản\s+sao\s+hộ\s+chiếu|phiếu\s+đăng\s+k[ýí][^.;\n]*|đơn\s+xin[^.;\n]*"
)
#: Characters after an action that its deadline, amount and place are looked for in, and before a date its time.
DEADLINE_WINDOW, AMOUNT_WINDOW, LOCATION_WINDOW, TIME_BEFORE = 350, 200, 400, 40
MOST_OBLIGATIONS, MOST_DOCUMENTS = 6, 8
GROUNDED = 0.88
# -------------------------------------------------------------------------------
_I = FLAGS


def spans(text: str | Column, pattern: str) -> Column:
    """array<struct<start, end>> of all matches of ``pattern``, which must not capture; offsets from 0."""
    one = lambda b, i: F.struct(
        (b[i]["start"] + F.length(b[i]["text"])).cast("int").alias("start"), b[i + 1]["start"].cast("int").alias("end")
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return let(
        pieces(text, pattern),
        lambda b: F.when(F.size(b) < 2, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: one(b, i)))
    )


def detect_audience(text: Column) -> Column:
    """struct(raw_text, applies_to_all_students, faculties, majors, cohorts, programs) of the first audience; null without."""
    def named(raw: Column) -> Column:
        has = lambda p: F.regexp_like(raw, F.lit(_I + p))
        years = F.regexp_extract_all(raw, F.lit(_I + r"kh[oó]a(?:\s+tuyển\s+sinh)?\s*(20\d{2})"), F.lit(1))
        return F.when(raw != "", F.struct(
            raw.alias("raw_text"), has(r"tất\s+cả.*sinh\s+viên").alias("applies_to_all_students"), F.expr(
                "cast(array() as array<string>)"
            ).alias("faculties"),
            F.array_compact(F.array(F.when(has(r"\bCNTT\b|Công\s+nghệ\s+Thông\s+tin"), "CNTT"))).alias("majors"),
            F.array_sort(F.array_distinct(F.transform(years, lambda y: F.concat(F.lit("K"), F.right(y, F.lit(2)))))).alias("cohorts"),
            F.array_compact(F.array(F.when(has(r"chính\s+quy"), "chính quy"), F.when(has(r"chương\s+trình\s+tiên\s+tiến"), "Chương trình tiên tiến"))).alias("programs")))

    return let(trim_space(F.regexp_extract(text, _I + AUDIENCE, 0)), named)


def detect_documents(text: Column) -> Column:
    """Up to eight distinct papers named in a text, in order."""
    return F.slice(
        F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_I + DOCUMENTS), F.lit(0)), trim_space)), 1, MOST_DOCUMENTS
    )


def _deadline(after: Column) -> Column:
    """The first date of what follows an action, the last if a range is spoken of; with the time shortly before it."""
    window = F.substring(after, 1, DEADLINE_WINDOW)
    ranged = F.regexp_like(window, F.lit(_I + r"\bđến\b"))

    def value(p: Column) -> Column:
        raw = F.substring(window, p["start"] + 1, p["end"] - p["start"])
        from_ = F.greatest(p["start"] - TIME_BEFORE, F.lit(0))
        time = F.try_element_at(F.regexp_extract_all(F.substring(window, from_ + 1, p["start"] - from_), F.lit(TIME), F.lit(0)), F.lit(-1))
        read = parse_deadline(F.concat_ws(" ", time, raw))
        return F.when(
            p.isNotNull(),
            let(read, lambda v: F.struct(raw.alias("raw_text"), v["normalized"].alias("normalized"), v["precision"].alias("precision")))
        )

    pick = let(
        spans(window, DATE),
        lambda f: F.when((F.size(f) > 1) & ranged, F.try_element_at(f, F.lit(-1))).otherwise(F.try_element_at(f, F.lit(1)))
    )
    return let(pick, value)


def rule_extract(notices: DataFrame) -> DataFrame:
    """(notice_id, version_id, ordinal, action_type, action_text, start_char, audience, deadline, amount_text, amount_vnd, location, documents).

    Actions in order of their place, one for each span (the first kind in the
    list), at most six. Money is looked for after payments only, papers go to
    what is submitted, applied or registered for. Rows without text give none.
    """
    t = F.col("raw_text")

    def found(i: int, kind: str, pattern: str) -> Column:
        return F.transform(
            spans(t, pattern),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(i).alias("order"), F.lit(kind).alias("kind"))
        )

    hits = F.array_sort(F.flatten(F.array(*[found(i, kind, p) for i, (kind, p) in enumerate(ACTIONS)])))
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"])
    once = let(hits, lambda h: F.filter(h, lambda x, i: (i == 0) | ~same(x, F.get(h, F.greatest(i - 1, F.lit(0))))))
    placed = F.array_sort(
        F.transform(
            once, lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), x["kind"].alias("kind"))
        )
    )
    # all of it stays in the notice's row; what holds for the whole notice is worked out once
    rows = notices.filter("raw_text is not null").select(
        "notice_id", "version_id", "raw_text", detect_audience(t).alias("audience"), detect_documents(t).alias("papers"),
        F.slice(placed, 1, MOST_OBLIGATIONS).alias("placed")
    )
    rows = rows.select(
        "notice_id", "version_id", "raw_text", "audience", "papers", F.posexplode_outer("placed").alias("ordinal", "a")
    ).filter("a is not null")  # an inner one would be preceded by a filter that finds all spans a second time
    after = F.substring("raw_text", F.col("a.end") + 1, F.lit(LOCATION_WINDOW))
    money = F.when(F.col("a.kind") == "pay", span_of(F.substring(after, 1, AMOUNT_WINDOW), MONEY)["text"])
    place = span_of(after, LOCATION, 1)["text"]
    papers = F.when(
        F.col("a.kind").isin("submit", "apply", "register"), F.col("papers")
    ).otherwise(F.expr("cast(array() as array<string>)"))
    return rows.select(
        "notice_id", "version_id", "ordinal", F.col("a.kind").alias("action_type"), F.substring(
            "raw_text", F.col("a.start") + 1, F.col("a.end") - F.col("a.start")
        ).alias("action_text"), F.col("a.start").alias("start_char"),
        "audience", _deadline(after).alias("deadline"), money.alias("amount_text"), parse_vnd(money).alias("amount_vnd"), trim_space(place).alias("location"), papers.alias("documents"))


def fold_quote(c: Column) -> Column:
    """Dashes and arrows as plain ones, single spaces, lower case."""
    plain = F.replace(F.translate(c, "–—", "--"), F.lit("→"), F.lit("->"))
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def ground(quotes: DataFrame, key: tuple[str, ...] = ("quote_id",)) -> DataFrame:
    """``key`` and ``grounded`` of ``quotes`` (key, quote, raw_text): the words of the source that the quote stands for, null if none.

    An exact part is itself; else the first line or sentence that is equal
    after folding and composing accents; else the best by containment or
    matching blocks from 0.88 on, the first of equals. Rows stay where they
    are and are read once; only texts without an exact part reach Python.
    """
    exact = F.contains("raw_text", F.col("quote"))
    rows = quotes.select(*key, F.when(exact, F.col("quote")).alias("__g"), *[F.when(~exact, F.col(c)).alias(c) for c in ("quote", "raw_text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, quote, text = (batch.column(c) for c in ("__g", "quote", "raw_text"))
            found = [x.as_py() if x.is_valid else grounded(q.as_py(), t.as_py()) for x, q, t in zip(g, quote, text)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], pa.array(found, pa.string())], names=[*key, "grounded"])

    schema = T.StructType([*quotes.select(*key).schema.fields, T.StructField("grounded", T.StringType())])
    return rows.mapInArrow(run, schema)


def ground_lists(rows: DataFrame, quotes: str = "quotes") -> DataFrame:
    """``rows`` (with raw_text and the list ``quotes``) with each quote of the list replaced by what :func:`ground` makes of it."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = ((q.as_py(), t.as_py()) for q, t in zip(batch.column(quotes), batch.column("raw_text")))
            found = [q and [grounded(x, t) for x in q] for q, t in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.string())) if n == quotes else batch.column(n) for n in names], names=names)

    kinds = [T.StructField(f.name, T.ArrayType(T.StringType())) if f.name == quotes else f for f in rows.schema.fields]
    return rows.mapInArrow(run, T.StructType(kinds))


#: White space as ``(?U)\s`` has it; ``str.split`` and ``str.strip`` also take these four.
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SEPARATORS = re.compile("[\x1c-\x1f]")
_RUNS, _SENTENCE = re.compile(f"[{_SPACES}]+"), re.compile(f"[.;!?][{_SPACES}]+")


def _remembered(f: Callable) -> Callable:
    """``f`` that is worked out once for short texts that come again, as lines of templates do."""
    known = lru_cache(8192)(f)
    return wraps(f)(lambda text, *more: known(text, *more) if len(text) < 256 else f(text, *more))


@_remembered
def _plain_fold(text: str) -> str:
    """As :func:`fold_quote`."""
    text = text.replace("\u2013", "-").replace("\u2014", "-").replace("\u2192", "->")
    return (_RUNS.sub(" ", text).strip(" ") if _SEPARATORS.search(text) else " ".join(text.split())).lower()


@lru_cache(1)  # the quotes of a text follow one another
def _parts(text: str) -> tuple[list[tuple[str, str]], bool]:
    """(text, folded) of the segments of a text, as :func:`herald.functions.text.segments`, and whether it has accents apart."""
    ends = [m.start() + 1 for m in _SENTENCE.finditer(text)]
    sentences = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]
    once = dict.fromkeys(x.strip(_SPACES) for x in (*text.splitlines(), *sentences))
    return [(x, _plain_fold(x)) for x in once if x], _marked(text)


_is_mark = lambda c: unicodedata.category(c)[0] == "M"
#: Marks of the basic plane, for which ``re`` has a table, and all characters beyond it.
_MARKS, _BEYOND = re.compile("[" + "".join(filter(_is_mark, map(chr, range(0x300, 0x10000)))) + "]"), re.compile("[\U00010000-\U0010ffff]")


def _marked(text: str) -> bool:
    """Whether letters may have accents of their own, which are composed before texts are compared."""
    return not text.isascii() and (_MARKS.search(text) is not None or any(map(_is_mark, _BEYOND.findall(text))))


def grounded(quote: str | None, text: str | None) -> str | None:
    """What :func:`ground` makes of one quote."""
    if quote is None or text is None or quote in text:
        return None if text is None else quote
    wanted = _plain_fold(quote)
    if not wanted:
        return None
    parts, marked = _parts(text)
    if marked or _marked(quote):
        return nearest(quote, parts)
    n, likely = len(wanted), []
    for p in parts:
        if p[1] == wanted:
            return p[0]
        if 2 * min(n, len(p[1])) >= GROUNDED * (n + len(p[1])):  # of others only those whose length allows the ratio
            likely.append(p)
    return nearest(quote, likely) if likely else None


@_remembered
def _fold(text: str) -> str:
    """As :func:`fold_quote`, with accents composed."""
    text = unicodedata.normalize("NFC", text).replace("\u2013", "-").replace("\u2014", "-").replace("\u2192", "->")
    return " ".join(text.split()).casefold()


@_remembered
def _likeness(wanted: str, folded: str, least: float) -> float:
    """The ratio of matching blocks, 0 if its upper bounds are below ``least``."""
    if 2.0 * min(len(wanted), len(folded)) / (len(wanted) + len(folded)) < least:
        return 0.0
    match = SequenceMatcher(None, wanted, folded)
    return match.ratio() if match.quick_ratio() >= least else 0.0


def nearest(quote: str, parts: list) -> str | None:
    """The segment of ``parts`` (text, folded) that a quote stands for, by equality after folding or a likeness from 0.88 on."""
    wanted, best, score = _fold(quote), None, 0.0
    if not wanted:
        return None
    for text, _ in parts:
        folded = _fold(text)
        if folded == wanted:
            return text
        longest = max(len(wanted), len(folded), 1)
        inside = min(len(wanted), len(folded)) / longest if wanted in folded or folded in wanted else 0.0
        # what cannot be accepted, or not beat the best, is not matched
        s = max(inside, _likeness(wanted, folded, max(score, GROUNDED)))
        if s > score and s >= GROUNDED:
            best, score = text, s
    return best


def anchored_line(text: Column, action_type: Column) -> Column:
    """The line, or lines, with the first anchor of an action type that occurs; null without."""
    def around(pattern: str) -> Column:
        def cut(m: Column) -> Column:
            before = F.substring_index(F.substring(text, F.lit(1), m["start"]), "\n", -1)
            after = F.substring_index(F.substring(text, m["start"] + F.length(m["text"]) + 1, F.length(text)), "\n", 1)
            line = trim_space(F.concat(before, m["text"], after))
            return F.when(m.isNotNull(), F.when(line != "", line).otherwise(m["text"]))

        return let(span_of(text, pattern), cut)

    out = None
    for kind, patterns in ANCHORS.items():
        found = F.coalesce(*[around(p) for p in patterns])
        out = F.when(action_type == kind, found) if out is None else out.when(action_type == kind, found)
    return out


def ground_actions(actions: DataFrame, key: tuple[str, ...] = ("action_id",)) -> DataFrame:
    """``key`` and ``grounded`` of ``actions`` (key, quote, action_type, raw_text): the quote grounded, else the line of an anchor of its type."""
    found = ground(actions.select(*key, "quote", "raw_text"), key).withColumnRenamed("grounded", "__g")
    rows = actions.join(found, list(key), "left")
    anchor = F.when(F.col("__g").isNull(), anchored_line(F.col("raw_text"), F.col("action_type")))
    return rows.select(*key, F.coalesce(F.when(F.col("__g") != "", F.col("__g")), anchor).alias("grounded"))


def sanitize_spans(spans_: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans that are exact parts of their text and used, and the uses whose span is left.

    ``spans_``: doc_id, evidence_id, text, raw_text. ``uses``: doc_id,
    obligation_id, field, evidence_id. An obligation without a grounded action
    goes with all its uses.
    """
    key = ["doc_id", "evidence_id"]
    good = spans_.filter(F.contains("raw_text", F.col("text")) & (F.col("text") != ""))
    left = uses.join(good.select(*key), key, "left_semi")
    acted = left.filter("field = 'action'").select("doc_id", "obligation_id").distinct()
    left = left.join(acted, ["doc_id", "obligation_id"], "left_semi")
    return good.join(left.select(*key), key, "left_semi"), left


def payload_errors(outputs: DataFrame) -> DataFrame:
    """(output_id, error) of rows (output_id, message, payload): the first rule that a model's JSON breaks, null if none.

    Claims are tried one after the other, each by all rules in their order.
    Values keep their JSON types: a number in quotes is no amount, and a
    forbidden key is one even if it is null. Texts may not be null where they
    are named, and must stand in the message.
    """
    # an object's keys and an array's items come as variants, which know their types
    p = outputs.withColumns({"__v": F.try_parse_json("payload"), "__k": F.json_object_keys("payload")})
    claims = F.expr("try_variant_get(__v, '$.claims', 'array<variant>')")
    one = F.col("c")
    kind = lambda key: F.schema_of_variant(F.try_variant_get(one, f"$.{key}", "variant"))
    text = lambda key: F.try_variant_get(one, f"$.{key}", "string")
    held = lambda v: F.contains("message", v)
    loose = lambda v: v.isNotNull() & ~held(v)
    papers = F.try_variant_get(one, "$.required_documents", "array<string>")
    error = (
        F.when(one.isNull() | ~F.startswith(F.schema_of_variant(one), F.lit("OBJECT")) | kind("verdict").isNotNull(), "TRUST_VERDICT_OR_INVALID_CLAIM")
        .when(F.coalesce(text("claim_text"), F.lit("")).isin("") | ~held(text("claim_text")), "UNGROUNDED_CLAIM")
        .when(text("action_normalized").isNotNull() & ~text("action_normalized").isin(*ANCHORS), "INVALID_ACTION")
        .when(
            (F.coalesce(text("deadline_normalized"), F.lit("")) != "") & (F.size(F.split(F.coalesce(text("deadline_raw"), F.lit("")), "/")) < 3),
            "INVENTED_YEAR")
        .when(F.coalesce(kind("amount_value"), F.lit("VOID")).rlike(r"^(?!VOID|BIGINT|BOOLEAN|DECIMAL\(\d+,0\))"), "INVALID_AMOUNT")
        .when(
            F.coalesce(F.exists(papers, loose), F.lit(False)) | loose(text("audience")) | loose(text("action")) | loose(text("deadline_raw"))
            | loose(text("amount_raw")), "UNGROUNDED_FIELD"))
    top = F.when(F.col("__k").isNull() | (F.size(F.array_except("__k", F.array(F.lit("claims")))) > 0) | claims.isNull(), "INVALID_TOP_LEVEL_SCHEMA")
    rows = p.select("output_id", "message", top.alias("top"), F.posexplode_outer(claims).alias("ix", "c"))
    rows = rows.select("output_id", F.when(F.col("top").isNotNull(), F.struct(F.lit(-1).alias("ix"), F.col("top").alias("error"))).when(
        F.col("ix").isNotNull() & error.isNotNull(), F.struct(F.col("ix"), error.alias("error"))).alias("e"))
    return rows.groupBy("output_id").agg(F.min("e")["error"].alias("error"))


def supported_deadlines(rows: DataFrame) -> DataFrame:
    """``rows`` (text, deadline) with the deadline nulled unless its day is one of the dates in the text."""
    return rows.withColumn("deadline", F.when(F.array_contains(dates_in("text"), date_iso("deadline")), F.col("deadline")))


def flatten_obligations(annotations: DataFrame) -> DataFrame:
    """One row for each obligation of annotations (notice_id, version_id, annotation_status, obligations)."""
    o = annotations.select("notice_id", "version_id", "annotation_status", F.posexplode("obligations").alias("ordinal", "o"))
    return o.select(
        "notice_id", "version_id", "annotation_status", "ordinal", F.col("o.obligation_id").alias("obligation_id"), F.col(
            "o.action.action_type"
        ).alias("off_action"), F.col("o.deadline.raw_text").alias("off_deadline"),
        F.col("o.deadline.normalized").alias("off_deadline_norm"), F.col("o.amount.value_vnd").alias("off_amount"), F.col("o.location.text").alias("location"), F.col("o.audience").alias("audience"))


def number_spans(quotes: DataFrame) -> DataFrame:
    """``quotes`` (doc_id, quote, raw_text) with evidence ids ``e1``, ``e2`` by first place, and exact offsets."""
    q = quotes.withColumn("start_char", F.position("quote", "raw_text") - 1).filter("start_char >= 0")
    q = q.select("doc_id", "quote", "start_char", (F.col("start_char") + F.length("quote")).alias("end_char")).distinct()
    w = Window.partitionBy("doc_id").orderBy("start_char", "end_char")
    return q.withColumn("evidence_id", F.concat(F.lit("e"), F.row_number().over(w).cast("string")))


#: Fields of a drafted obligation in the order that their evidence is numbered in; the last two are lists.
DRAFT_FIELDS = ("action", "audience", "deadline", "amount", "location", "document", "exception")


def draft_obligations(drafts: DataFrame) -> DataFrame:
    """Drafts (draft_id, notice_id, version_id, raw_text, action_type, action_quote and, where there are any, audience_quote,
    deadline_quote, amount_quote, location_quote, document_quotes, exception_quotes) as obligations.

    Each quote is grounded in the text and read again from there. An obligation
    without a grounded action is dropped; a field that is not grounded is null,
    and so is an amount that holds no money; papers and exceptions keep the
    grounded ones in their order. ``obligation_id`` counts the obligations of a
    version in the order of their drafts. Empty quotes are none.
    """
    has = lambda c, kind: F.col(c) if c in drafts.columns else F.lit(None).cast(kind)
    ones = [F.nullif(has(f"{f}_quote", "string"), F.lit("")) for f in DRAFT_FIELDS[1:5]]
    none = F.expr("cast(array() as array<string>)")
    papers, others = (
        F.transform(F.coalesce(has(f"{f}_quotes", "array<string>"), none), lambda x: F.nullif(x, F.lit(""))) for f in DRAFT_FIELDS[5:])
    # all quotes of a draft stay in its row, one after the other: the single fields, the papers, the exceptions
    rows = drafts.select(
        "draft_id", "notice_id", "version_id", "raw_text", "action_type", F.size(papers).alias("n"),
        F.concat(F.array("action_quote", *ones), papers, others).alias("quotes"))
    g = lambda i: F.get("quotes", F.lit(i))
    action = F.when(g(0).isNull(), anchored_line(F.col("raw_text"), F.col("action_type"))).when(g(0) != "", g(0))
    j = ground_lists(rows).select(
        "draft_id", "notice_id", "version_id", "raw_text", "action_type", action.alias("action_text"),
        *[g(i).alias(f"g_{f}") for i, f in enumerate(DRAFT_FIELDS[1:5], 1)], F.array_compact(F.slice("quotes", 6, F.col("n"))).alias("documents"),
        F.array_compact(F.slice("quotes", F.col("n") + 6, F.size("quotes"))).alias("exceptions")).filter("action_text is not null")
    w = Window.partitionBy("notice_id", "version_id").orderBy("draft_id")
    read = parse_deadline(F.col("g_deadline"))
    money = parse_vnd(F.coalesce("g_amount", F.lit("")))
    return j.select(
        "notice_id", "version_id", F.concat(F.lit("o"), F.row_number().over(w).cast("string")).alias("obligation_id"), "draft_id", "raw_text",
        "action_type", "action_text", (F.position("action_text", "raw_text") - 1).alias("start_char"), F.col("g_audience").alias("audience"),
        F.col("g_deadline").alias("deadline_text"), F.when(F.col("g_deadline").isNotNull(), read["normalized"]).alias("deadline"),
        F.when(F.col("g_deadline").isNotNull(), read["precision"]).alias("precision"), F.when(money.isNotNull(), F.col("g_amount")).alias("amount_text"),
        money.alias("amount"), F.col("g_location").alias("location"), "documents", "exceptions")


def draft_evidence(obligations: DataFrame) -> DataFrame:
    """(notice_id, version_id, evidence_id, field, text, start_char, end_char) of the obligations of :func:`draft_obligations`.

    A text is evidence once for each field; ids count a version's in the order
    of obligations and fields. ``start_char`` is the first place in the text.
    """
    values = {
        "action": F.array("action_text"), "audience": F.array("audience"), "deadline": F.array("deadline_text"), "amount": F.array("amount_text"),
        "location": F.array("location"), "document": F.col("documents"), "exception": F.col("exceptions")}
    rows = [_placed(n, f, values[f]) for n, f in enumerate(DRAFT_FIELDS)]
    number = F.substring("obligation_id", F.lit(2), F.length("obligation_id")).cast("long")
    key = ["notice_id", "version_id"]
    # outer: before an inner one Spark would work the list out twice
    long = obligations.select(*key, number.alias("o"), F.explode_outer(F.flatten(F.array(*rows))).alias("r")).filter("r.text is not null")
    at = F.shiftleft("o", 31) + F.shiftleft(F.col("r.n").cast("long"), 28) + F.col("r.ix")  # one number: a struct would be sorted, not hashed
    first = long.groupBy(*key, "r.field", "r.text").agg(F.min(at).alias("at"), F.min("r.place").alias("place"))
    w = Window.partitionBy(*key).orderBy("at")
    start = F.col("place") - 1
    return first.select(
        *key, F.concat(F.lit("e"), F.row_number().over(w).cast("string")).alias("evidence_id"), "field", "text", start.alias("start_char"),
        (start + F.length("text")).alias("end_char"))


def _placed(n: int, field: str, values: Column) -> Column:
    place = lambda x: F.position(x, F.col("raw_text")).alias("place")
    return F.transform(values, lambda x, i: F.struct(F.lit(n).alias("n"), F.lit(field).alias("field"), i.alias("ix"), x.alias("text"), place(x)))


def inexact_evidence(spans_: DataFrame) -> DataFrame:
    """(doc_id, evidence_id, rule) of spans (doc_id, evidence_id, text, start_char, end_char, raw_text) that do not stand in their text as they say."""
    held = F.coalesce(F.contains("raw_text", F.col("text")) & (F.col("text") != ""), F.lit(False))
    there = F.substring("raw_text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    rule = F.when(~held, "text not in source").when(
        F.col("start_char").isNotNull() & ~there.eqNullSafe(F.col("text")), "text not at its offsets"
    )
    return spans_.select("doc_id", "evidence_id", rule.alias("rule")).filter("rule is not null")
