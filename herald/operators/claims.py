"""Received messages: claims with exact spans, and their typed fields.

Everything is string expressions, so a table of messages of any size stays in
the JVM. Offsets count code points from 0, and ``substring(message, start + 1,
end - start)`` is always the claim's or field's text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herald.functions.text import clean_text, let, parse_deadline, parse_vnd, pieces, span_of, trim_space

# --- Fixed values: the wording that fields are recognised by -----------------
BLANK_LINE = r"(?:\r?\n[ \t]*){2,}"
SENTENCE_END = r"\.\s+|[!?]+"
NEXT_ACTION = (
    r"(?:\s+và\s+|,\s*)(?=(?:đăng\s+k[ýí]\b|đóng\s+(?:học\s*phí|lệ\s*phí|phí|tiền)\b|đóng\s+\d|"
    r"nộp\b|tham\s+gia\b|nhận\b|cập\s+nhật\b|kiểm\s+tra\b|sinh\s+viên\s+K\d{2}\s+(?:đăng\s+k[ýí]|nộp)\b))"
)
#: (type, pattern); the verb is group 1. Earliest verb wins, ties by this order.
ACTIONS = [
    ("pay", r"\b(đóng)\s+(?:học\s*phí|lệ\s*phí|phí|tiền|BHYT|bảo\s+hiểm|khoản\s+phí)\b"),
    ("pay", r"\b(đóng)\s+\d[\d.,\s]*(?:đồng|vnđ|vnd|đ)\b"),
    ("pay", r"\b(thanh\s+toán)\b"),
    ("pay", r"\b(nộp)\s+(?:học\s*phí|lệ\s*phí|phí|tiền)\b"),
    ("register", r"\b(đăng\s+k[ýí])\b"),
    ("apply", r"\b(ứng\s+tuyển)\b"),
    ("submit", r"\b(nộp)\b"),
    ("attend", r"\b(tham\s+gia)\b"),
    ("collect", r"\b(nhận)\s+(?:kết\s+quả|thẻ(?:\s+sinh\s+viên)?|giấy(?:\s+xác\s+nhận)?|chứng\s+nhận|học\s+bổng|biên\s+lai)\b"),
    ("update", r"\b(cập\s+nhật|tự\s+đánh\s+giá)\b"),
    ("check", r"\b(kiểm\s+tra|xem)\b"),
    ("other", r"\b(hoàn\s+thành|thực\s+hiện)\b"),
]
FULL_DATE = r"\d{1,2}[./-]\d{1,2}[./-]\d{4}"
SHORT_DATE = r"(?:(?:trước|đến)\s+(?:hết\s+)?(?:ngày\s+)?|hạn\s+cuối\s*:?[ \t]*)(\d{1,2}[./-]\d{1,2})(?![./-]\d)"
MONEY = r"\b(?:\d{1,3}(?:[.,\s]\d{3})+|\d+)(?=\s*(?:đồng|vnđ|vnd|đ)\b)|\b\d+\s*k\b"
AUDIENCES = [
    r"\bk\s*(\d{2})\b", r"\b(?:sinh\s+viên|sv)\s+k\s*(\d{2})\b", r"\b(?:sinh\s+viên|sv)\s+khóa\s*(\d{2})\b",
    r"\b(?:sinh\s+viên\s+)?khóa\s+tuyển\s+sinh\s+(20\d{2})\b"
]
LOCATION = r"(?:địa\s*điểm\s*:\s*|\btại\s+)((?:Phòng|Khu|Ban|Trường|Văn\s+phòng|Hội\s+trường)[^.;\r\n]{0,100})"
DOCUMENT_CUE = r"hồ\s+sơ\s+gồm|cần\s+nộp|bao\s+gồm"
DOCUMENTS = r"đơn\s+đăng\s+k[ýí]|bản\s+sao\s+CCCD|bản\s+sao\s+CMND|CCCD|CMND|bảng\s+điểm|chứng\s+chỉ"
EXCEPTIONS = r"\b(?:trừ|ngoại\s+trừ|không\s+áp\s+dụng\s+cho)\s+[^.;\r\n]+"
OBJECT = r"^\s+([^,.;\r\n]+?)\s*(?=(?:trước|đến|hạn\s+cuối)\b|$)"
MONEY_OBJECT = r"^(?:\d[\d.,\s]*(?:đồng|vnđ|vnd|đ)|học\s*phí|lệ\s*phí|phí|tiền)$"
# -----------------------------------------------------------------------------
_I = "(?iuU)"


def _lead(text: Column) -> Column:
    """White space before the text, in characters."""
    return F.length(text) - F.length(F.regexp_replace(text, r"(?U)^\s+", ""))


def _moved(base: Column, parts: Column) -> Column:
    """Parts (start, text) trimmed, their starts counted from ``base``; blank ones go."""
    out = F.transform(
        parts, lambda p: F.struct((base + p["start"] + _lead(p["text"])).cast("int").alias("start"), trim_space(p["text"]).alias("text"))
    )
    return F.filter(out, lambda p: p["text"] != "")


def _sentences(block: Column) -> Column:
    """array<struct<start, text, open>> of a block: itself if it has several lines; ``open`` is the last one if nothing ends it."""
    one = F.array(F.struct(block["start"].alias("start"), block["text"].alias("text"), F.lit(False).alias("open")))

    def cut(parts: Column) -> Column:
        marked = F.transform(
            parts,
            lambda x, i: F.struct(
                (block["start"] + x["start"] + _lead(x["text"])).cast("int").alias("start"), trim_space(x["text"]).alias("text"),
                (i == F.size(parts) - 1).alias("open")
            )
        )
        return F.filter(marked, lambda x: x["text"] != "")

    return F.when(F.regexp_like(block["text"], F.lit(r"[\r\n]")), one).otherwise(let(pieces(block["text"], SENTENCE_END), cut))


def _clauses(sentence: Column) -> Column:
    whole = F.array(F.struct(sentence["start"].alias("start"), sentence["text"].alias("text")))
    return F.when(sentence["open"], _moved(sentence["start"], pieces(sentence["text"], NEXT_ACTION))).otherwise(whole)


def segment_claims(messages: DataFrame) -> DataFrame:
    """(message_id, claim_ix, start_char, end_char, text) of rows (message_id, text).

    Blank lines part a message into blocks. A block of several lines is one
    claim; else its sentences are, and the last of them, if nothing ends it,
    falls apart before further known actions. Messages without text give no
    claim. Each row is cut where it lies, so equal message_ids do no harm.
    """
    blocks = _moved(F.lit(0), pieces("text", BLANK_LINE))
    claims = F.flatten(F.transform(blocks, lambda b: F.flatten(F.transform(_sentences(b), _clauses))))
    # outer: before an inner one Spark would filter empty arrays, and so cut every message twice
    c = messages.select("message_id", F.posexplode_outer(claims).alias("claim_ix", "c")).filter("c is not null")
    return c.select(
        "message_id", "claim_ix", F.col("c.start").alias("start_char"),
        (F.col("c.start") + F.length("c.text")).cast("int").alias("end_char"), F.col("c.text").alias("text")
    )


def _plain(pattern: str) -> str:
    """The pattern without capturing groups."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def action(text: Column) -> Column:
    """struct(start, order, text, type) of the earliest action, null without.

    One search for all patterns finds the earliest, of those at one place the
    first in the list; the short text found tells which it was.
    """
    any_ = "|".join(f"(?:{_plain(p)})" for _, p in ACTIONS)

    def found(s: Column) -> Column:
        out = F.when(s.isNull(), None)
        for i, (kind, pattern) in enumerate(ACTIONS):
            verb = F.regexp_extract(s["text"], f"{_I}^(?:{pattern})$", 1)
            out = out.when(
                verb != "", F.struct(s["start"].alias("start"), F.lit(i).alias("order"), verb.alias("text"), F.lit(kind).alias("type"))
            )
        return out

    return let(span_of(text, any_), found)


def deadline(text: Column) -> Column:
    """struct(start, text, normalized): the first full date, else a date without year after a cue, which stays unnormalised."""
    full = let(
        span_of(text, FULL_DATE),
        lambda s: F.when(
            s.isNotNull(),
            F.struct(s["start"].alias("start"), s["text"].alias("text"), parse_deadline(s["text"])["normalized"].alias("normalized"))
        )
    )
    short = let(
        span_of(text, SHORT_DATE, 1),
        lambda s: F.when(
            s.isNotNull(), F.struct(s["start"].alias("start"), s["text"].alias("text"), F.lit(None).cast("string").alias("normalized"))
        )
    )
    return F.coalesce(full, short)


def amount(text: Column) -> Column:
    """struct(start, text, value) of the first sum of money."""

    def value(s: Column) -> Column:
        tail = F.substring(text, s["start"] + 1, F.length(s["text"]) + 20)
        unit = F.substring_index(F.regexp_replace(tail, _I + r"((?:đồng|vnđ|vnd|đ|k)\b)", "$1\u0001"), "\u0001", 1)
        return F.when(s.isNotNull(), F.struct(s["start"].alias("start"), s["text"].alias("text"), parse_vnd(unit).alias("value")))

    return let(span_of(text, MONEY), value)


def audience(text: Column) -> Column:
    """struct(start, text, cohort) of the earliest cohort, as ``Kyy``; of those at one place the first in the list."""

    year = lambda s: F.concat(F.lit("K"), F.regexp_extract(s["text"], r"(\d{2})$", 1))
    any_ = "|".join(f"(?:{_plain(p)})" for p in AUDIENCES)
    return let(
        span_of(text, any_),
        lambda s: F.when(s.isNotNull(), F.struct(s["start"].alias("start"), s["text"].alias("text"), year(s).alias("cohort")))
    )


def location(text: Column) -> Column:
    """struct(start, text, normalized) of a named place after a cue."""
    return let(
        span_of(text, LOCATION, 1),
        lambda s: F.when(
            s.isNotNull(), F.struct(s["start"].alias("start"), s["text"].alias("text"), clean_text(s["text"]).alias("normalized"))
        )
    )


def documents(text: Column) -> Column:
    """Named papers, once each whatever their case; only where a cue asks for papers."""
    all_ = F.regexp_extract_all(text, F.lit(_I + DOCUMENTS), F.lit(0))
    first = F.filter(all_, lambda x, i: F.array_position(F.transform(all_, F.lower), F.lower(x)) == i + 1)
    return F.when(F.regexp_like(text, F.lit(_I + DOCUMENT_CUE)), first).otherwise(F.expr("cast(array() as array<string>)"))


def exceptions(text: Column) -> Column:
    """Phrases that except someone."""
    return F.regexp_extract_all(text, F.lit(_I + EXCEPTIONS), F.lit(0))


def object_hint(text: Column, act: Column) -> Column:
    """The phrase after the action up to a cue, unless it is money or a fee; null without."""
    tail = F.substring(text, act["start"] + F.length(act["text"]) + 1, F.lit(100_000))
    phrase = trim_space(F.regexp_extract(tail, _I + OBJECT, 1))
    return F.when(act.isNotNull() & (phrase != "") & ~F.regexp_like(phrase, F.lit(_I + MONEY_OBJECT)), clean_text(phrase))


def extract_claims(messages: DataFrame) -> DataFrame:
    """:func:`segment_claims` with the fields action, deadline, amount, audience, location, object_hint, documents, exceptions.

    ``claim_id`` is a digest of message and offset. Null fields were not found.
    """
    c, t = segment_claims(messages), F.col("text")
    c = c.withColumn("claim_id", F.sha2(F.concat_ws(":", F.col("message_id").cast("string"), "start_char"), 256))
    c = c.withColumns(
        {
            "normalized_text": clean_text(t), "action": action(t), "deadline": deadline(t), "amount": amount(t), "audience": audience(t),
            "location": location(t), "documents": documents(t), "exceptions": exceptions(t)
        }
    )
    return c.withColumn("object_hint", object_hint(t, F.col("action")))


def understood_fields(claims: DataFrame) -> DataFrame:
    """(message_id, claim_ix, understood): names of the fields found, in a fixed order."""
    names = ["action", "deadline", "amount", "audience", "location"]
    found = [F.when(F.col(n).isNotNull(), n) for n in names] + [F.when(F.size(n) > 0, n) for n in ("documents", "exceptions")]
    return claims.select("message_id", "claim_ix", F.array_compact(F.array(*found)).alias("understood"))


def compose(texts: DataFrame, column: str) -> DataFrame:
    """``texts`` with ``column`` in composed form (NFC). Spark has no function for it; rows without combining marks, nearly all, do not leave the JVM."""
    marks = F.regexp_like(column, F.lit(r"\p{M}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([unicodedata.normalize("NFC", t) for t in batch.column(column).to_pylist()], pa.string())
            yield batch.set_column(batch.schema.get_field_index(column), column, made)

    return texts.filter(~F.coalesce(marks, F.lit(False))).unionByName(texts.filter(marks).mapInArrow(run, texts.schema))


def with_normalized(claims: DataFrame) -> DataFrame:
    """Claims with ``normalized_text``: composed, with single spaces."""
    return compose(claims.withColumn("normalized_text", clean_text("text")), "normalized_text")
