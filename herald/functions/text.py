"""Text, date and money expressions; each takes and returns a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags for Vietnamese text: case folding and classes by Unicode.
FLAGS = "(?iuU)"
#: Presentation badges at the end of a title (fixed values).
BADGES = r"(?iuU)(?:\s+(?:Hot|New))+\s*$"
#: Letters of Vietnamese that have no decomposition (fixed values).
STROKES = ("đĐ", "dd")
ZONE = "Asia/Ho_Chi_Minh"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def clean_text(c: str | Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def clean_title(c: str | Column) -> Column:
    """:func:`clean_text` without badges at the end."""
    return F.trim(F.regexp_replace(clean_text(c), BADGES, ""))


def trim_space(c: str | Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def norm_text(c: str | Column) -> Column:
    """Lower case, single spaces, without ``.,;:()``; null as empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[.,;:()]", ""), r"(?U)\s+", " "))


def fold_key(c: str | Column) -> Column:
    """Lower case with single spaces: the key of texts that count as the same."""
    return F.lower(clean_text(F.coalesce(col(c), F.lit(""))))


_ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
_PLAIN = "a" * 17 + "e" * 11 + "i" * 5 + "o" * 17 + "u" * 11 + "y" * 5 + "d"


def fold_vietnamese(c: str | Column) -> Column:
    """Lower case without accents, only ``a-z0-9`` and single spaces."""
    lower = F.lower(F.coalesce(col(c), F.lit("")))
    plain = F.regexp_replace(F.translate(lower, _ACCENTED, _PLAIN), r"\p{M}", "")
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def tokens(c: str | Column) -> Column:
    """Lower-case runs of Unicode word characters."""
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"(?U)\W+"), lambda x: x != F.lit(""))


def digits(c: str | Column) -> Column:
    """All digits of a text as one number, -1 without any."""
    return F.coalesce(F.regexp_replace(col(c), r"\D", "").try_cast("bigint"), F.lit(-1).cast("bigint"))


def date_iso(c: str | Column) -> Column:
    """The first ISO date of a text, else the first day-month-year; null if that is no calendar date."""
    iso = F.regexp_extract(col(c), r"\d{4}-\d{2}-\d{2}", 0)
    dmy = F.regexp_extract(F.regexp_replace(col(c), "-", "/"), r"\d{1,2}/\d{1,2}/\d{4}", 0)
    day = F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).otherwise(F.try_to_date(dmy, "d/M/yyyy"))
    return F.date_format(day, "yyyy-MM-dd")


_FULL = r"(?U)\d{1,2}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{4}"
_TIME = r"(?iuU)(\d{1,2})\s*(?:h|:)\s*(\d{0,2})"


def parse_deadline(c: str | Column) -> Column:
    """struct(normalized, precision) of the last full date of a text.

    A time within 60 characters before or 40 after, the last one there, makes
    it a local date and time with its offset. What is no calendar date or time
    of day is not guessed: null and ``unknown``.
    """
    text = col(c)
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(_FULL), F.lit(0)), F.lit(-1))
    return let(F.struct(text.alias("text"), last.alias("last")), lambda x: _read_date(x["text"], x["last"]))


def _read_date(text: Column, last: Column) -> Column:
    before = F.length(text) - F.position(F.reverse(last), F.reverse(text)) + 1 - F.length(last)
    from_ = F.greatest(before - 60, F.lit(0))
    near = F.substring(text, from_ + 1, before + F.length(last) + 40 - from_)
    time = F.try_element_at(F.regexp_extract_all(near, F.lit(_TIME), F.lit(0)), F.lit(-1))
    day = F.regexp_replace(F.regexp_replace(last, r"(?U)\s+", ""), r"[.-]", "/")

    def value(x: Column) -> Column:
        minute = F.regexp_extract(x["time"], _TIME, 2)
        clock = F.concat_ws(":", F.regexp_extract(x["time"], _TIME, 1), F.when(minute == "", "0").otherwise(minute))
        at = F.date_format(F.try_to_timestamp(F.concat_ws(" ", x["day"], clock), F.lit("d/M/yyyy H:m")), "yyyy-MM-dd'T'HH:mm:ss'+07:00'")
        return F.when(x["day"].isNull(), None).when(x["time"].isNotNull(), at).otherwise(
            F.date_format(F.try_to_date(x["day"], "d/M/yyyy"), "yyyy-MM-dd")
        )

    both = let(
        F.struct(day.alias("day"), time.alias("time")), lambda x: F.struct(value(x).alias("value"), x["time"].isNotNull().alias("timed"))
    )
    return let(
        both,
        lambda v: F.struct(
            v["value"].alias("normalized"),
            F.when(v["value"].isNull(), "unknown").when(v["timed"], "datetime").otherwise("date").alias("precision")
        )
    )


def parse_vnd(c: str | Column) -> Column:
    """Whole VND: ``NNk``, else millions with a decimal comma or point, else a number with a currency word; null without."""
    text = col(c)
    k = F.regexp_extract(text, r"(?iuU)\b(\d+)\s*k\b", 1)
    million = F.regexp_extract(text, r"(?iuU)(\d+(?:[.,]\d+)?)\s*triệu", 1)
    vnd = F.regexp_extract(text, r"(?iuU)(\d{1,3}(?:[.,\s]\d{3})+|\d+)\s*(?:đồng|vnđ|vnd|đ)\b", 1)
    return (F.when(k != "", k.try_cast("bigint") * 1000)
            .when(million != "", F.floor(F.replace(million, F.lit(","), F.lit(".")).try_cast("double") * 1000000).cast("bigint"))
            .when(vnd != "", F.regexp_replace(vnd, r"\D", "").try_cast("bigint")))


def dates_in(c: str | Column) -> Column:
    """Distinct calendar dates (ISO) of a text in day-month-year or ISO form, in order."""
    dmy = F.transform(
        F.regexp_extract_all(col(c), F.lit(_FULL), F.lit(0)),
        lambda x: F.date_format(
            F.try_to_date(F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", ""), r"[.-]", "/"), "d/M/yyyy"), "yyyy-MM-dd"
        )
    )
    iso = F.transform(
        F.regexp_extract_all(col(c), F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)),
        lambda x: F.date_format(F.try_to_date(x, "yyyy-MM-dd"), "yyyy-MM-dd")
    )
    return F.array_distinct(F.array_compact(F.concat(dmy, iso)))


#: Ends of lines (fixed values).
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"


def segments(c: str | Column) -> Column:
    """Distinct trimmed lines and sentences of a text, in order: the lines first, then the sentences, which may go over lines."""
    text = F.coalesce(col(c), F.lit(""))
    parts = F.concat(F.split(text, LINE_END), F.split(text, r"(?U)(?<=[.;!?])\s+"))
    return F.filter(F.array_distinct(F.transform(parts, trim_space)), lambda x: x != F.lit(""))


def running(lengths: Column, block: int = 256) -> Column:
    """The sums of the numbers before each one. Blocks are summed first, so that no long array is copied for each step."""
    def plain(xs: Column, base: Column) -> Column:
        zero = F.struct(base.cast("int").alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(
            xs, zero, lambda a, x: F.struct((a["at"] + x).cast("int").alias("at"), F.array_append(a["out"], a["at"]).alias("out")),
            lambda a: a["out"]
        )

    def blocked(xs: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda i: F.slice(xs, i * block + 1, block)
        )
        sums = lambda ps: F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return let(parts, lambda ps: F.flatten(F.zip_with(ps, plain(sums(ps), F.lit(0)), plain)))

    return let(lengths, lambda xs: F.when(F.size(xs) <= block, plain(xs, F.lit(0))).otherwise(blocked(xs)))


def pieces(c: str | Column, separator: str) -> Column:
    """array<struct<start, text>>: what lies between matches of ``separator``, which are not empty; offsets from 0."""
    text, pattern = col(c), FLAGS + separator

    def place(parts: Column) -> Column:
        between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        at = running(F.zip_with(parts, between, lambda x, s: F.length(x) + F.coalesce(F.length(s), F.lit(0))))
        return F.zip_with(at, parts, lambda i, x: F.struct(i.alias("start"), x.alias("text")))

    return let(F.split(text, pattern, -1), place)


def span_of(c: Column, pattern: str, group: int = 0) -> Column:
    """struct(start, text) of the first match of ``pattern`` (its group), null without; offsets count code points from 0.

    ``pattern`` must not hold other capturing groups than those up to ``group``.
    """
    def found(whole: Column) -> Column:
        head = F.length(F.get(F.split(c, FLAGS + pattern, 2), F.lit(0)))
        if not group:
            return F.when(whole != "", F.struct(head.cast("int").alias("start"), whole.alias("text")))
        text = F.regexp_extract(c, FLAGS + pattern, group)
        return F.when(
            whole != "",
            let(
                text,
                lambda t: F.struct((head + F.greatest(F.position(t, whole) - 1, F.lit(0))).cast("int").alias("start"), t.alias("text"))
            )
        )

    return let(F.regexp_extract(c, FLAGS + pattern, 0), found)
