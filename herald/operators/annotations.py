"""Annotations: violations, reviewed obligations, promotion, curation, packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herald.functions.text import fold_key

#: Words that make a notice worth annotating (fixed values).
KEYWORDS = ("sinh viên", "đăng ký", "nộp", "học phí", "lệ phí", "thời hạn", "hạn", "tham gia", "địa điểm", "hồ sơ", "thời gian", "thu")
REVIEWED = ("REVIEWED", "GOLD")


def annotation_violations(spans: DataFrame, obligations: DataFrame, uses: DataFrame, relations: DataFrame) -> DataFrame:
    """(notice_id, rule, item): one row for each broken rule.

    ``spans``: notice_id, evidence_id, text, start_char, end_char, raw_text.
    ``obligations``: notice_id, obligation_id, deadline, precision, timezone,
    amount, and event_start and event_end if there are occurrences. ``uses``:
    notice_id, obligation_id, evidence_id. ``relations``: notice_id,
    target_notice_id.
    """
    twice = lambda df, c, rule: df.groupBy("notice_id", c).agg(F.count("*").alias("n")).filter("n > 1").select(
        "notice_id", F.lit(rule).alias("rule"), F.col(c).cast("string").alias("item")
    )
    bad = lambda df, c, rule, test: df.filter(test).select("notice_id", F.lit(rule).alias("rule"), F.col(c).cast("string").alias("item"))
    exact = F.substring("raw_text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    day, moment = F.try_to_date("deadline", "yyyy-MM-dd"), F.try_to_timestamp("deadline")
    zone = F.regexp_like("deadline", F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    found = [
        twice(spans, "evidence_id", "evidence_id is not unique"), twice(obligations, "obligation_id", "obligation_id is not unique"),
        bad(
            uses.join(spans.select("notice_id", "evidence_id").distinct(), ["notice_id", "evidence_id"], "left_anti"), "evidence_id",
            "unknown evidence_id", F.lit(True)
        ),
        bad(spans, "evidence_id", "one offset only", F.col("start_char").isNull() != F.col("end_char").isNull()),
        bad(
            spans, "evidence_id", "text does not match offsets",
            F.col("start_char").isNotNull() & F.col("end_char").isNotNull() & ~exact.eqNullSafe(F.col("text"))
        ),
        bad(
            obligations, "obligation_id", "deadline is no date",
            F.col("deadline").isNotNull() & (F.col("precision") == "date") & day.isNull()
        ),
        bad(
            obligations, "obligation_id", "deadline is no time",
            F.col("deadline").isNotNull() & (F.col("precision") == "datetime") & (moment.isNull() | ~zone)
        ),
        bad(obligations, "obligation_id", "amount is negative", F.col("amount") < 0), bad(
            relations, "target_notice_id", "relation to itself", F.col("notice_id") == F.col("target_notice_id")
        ),
    ]
    if {"event_start", "event_end"} <= set(obligations.columns):
        found.append(bad(obligations, "obligation_id", "event ends before it starts", F.col("event_end") < F.col("event_start")))
    return reduce(DataFrame.unionByName, found)


def completeness(annotations: DataFrame) -> DataFrame:
    """(notice_id, rule) of annotations (notice_id, annotation_status, annotator_id, quote, raw_text) that are not ready."""
    rule = (F.when(~F.col("annotation_status").isin(*REVIEWED), "not reviewed").when(F.coalesce(F.trim("annotator_id"), F.lit("")) == "", "no annotator")
            .when(~F.coalesce(F.contains("raw_text", F.col("quote")), F.lit(False)), "quote not in text"))
    return annotations.select("notice_id", rule.alias("rule")).filter("rule is not null")


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key of both tables by ``order``; the new one on a tie."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in stored.columns if c not in key]
    return both.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(order, "__new")).alias("r")
    ).select(*key, "r.*").select(*stored.columns)


def reviewed(annotations: DataFrame) -> DataFrame:
    """Annotations of a reviewed status; there is no fallback to others."""
    return annotations.filter(F.col("annotation_status").isin(*REVIEWED))


def promote(annotations: DataFrame, drafts: DataFrame, key: list[str]) -> DataFrame:
    """``annotations`` and promoted drafts that name a reviewer, as REVIEWED, where there is no annotation yet."""
    ready = drafts.filter((F.col("state") == "PROMOTED") & (F.coalesce(F.trim("reviewer"), F.lit("")) != ""))
    new = ready.join(annotations.select(*key).distinct(), key, "left_anti").withColumn("annotation_status", F.lit("REVIEWED"))
    return annotations.unionByName(new.select(*annotations.columns))


def repair_metadata(annotations: DataFrame, notices: DataFrame, columns: list[str], key: str = "notice_id") -> DataFrame:
    """``annotations`` with metadata columns taken from the notices where they have them."""
    n = notices.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    j = annotations.join(n, key, "left")
    return j.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in annotations.columns])


def keyword_score(text: Column, words: tuple[str, ...] = KEYWORDS) -> Column:
    """How many of the words a text has, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def select_batch(scored: DataFrame, quotas: dict[str, int], total: int) -> DataFrame:
    """Rows (notice_id, source_id, score) to review: each source's quota of its best, then the best others up to ``total``; ties by id descending."""
    best = [F.col("score").desc(), F.col("notice_id").desc()]
    # a top-k report: each part keeps its best rows where they are read, so no source is ranked as a whole
    own = [scored.filter(F.col("source_id") == s).orderBy(*best).limit(n).withColumn("by_quota", F.lit(True)) for s, n in quotas.items()]
    first = reduce(DataFrame.unionByName, own, scored.limit(0).withColumn("by_quota", F.lit(True)))
    others = scored.orderBy(*best).limit(total + sum(quotas.values())).join(first.select("notice_id"), "notice_id", "left_anti")
    rows = first.unionByName(others.withColumn("by_quota", F.lit(False)).select(*first.columns))
    return rows.orderBy(F.col("by_quota").desc(), *best).limit(total)


def gold_pack(notices: DataFrame, obligations: DataFrame) -> DataFrame:
    """(notice_id, version_id, obligation_id, state): accepted rows for reviewed obligations, a candidate row for notices without."""
    o = obligations.filter(F.col("annotation_status").isin(*REVIEWED)).select("notice_id", "version_id", "obligation_id")
    j = notices.select("notice_id", "version_id").join(o, ["notice_id", "version_id"], "left")
    return j.withColumn("state", F.when(F.col("obligation_id").isNotNull(), "accepted").otherwise("candidate"))


def apply_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """``records`` (record_id, span, raw_text) after decisions (record_id, decision, new_span): reject, edit or accept.

    ``valid`` says whether the resulting span stands exactly once in the text;
    undecided records are left out of the result with rejected ones.
    """
    j = records.join(decisions, "record_id").filter("decision != 'reject'")
    span = F.when(F.col("decision") == "edit", F.col("new_span")).otherwise(F.col("span"))
    times = (F.length("raw_text") - F.length(F.replace("raw_text", span))) / F.length(span)
    return j.select("record_id", "decision", span.alias("span"), F.coalesce(times == 1, F.lit(False)).alias("valid"))


def field_support(flat: DataFrame, fields: list[str], by: str) -> DataFrame:
    """For each value of ``by``: obligations, and how many have each field."""
    return flat.groupBy(by).agg(F.count("*").alias("obligations"), *[F.count(f).alias(f"with_{f}") for f in fields])


def case_violations(cases: DataFrame, frozen: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """(case_id, rule) of evaluation cases (case_id, text, span, action, claim_count, claims) against the rules and a frozen set (text)."""
    c = cases.withColumn("__k", fold_key("text"))
    row = lambda df, rule: df.select("case_id", F.lit(rule).alias("rule"))
    many = lambda *k: c.join(c.groupBy(*k).agg(F.count("*").alias("__n")).filter("__n > 1").select(*k), list(k), "left_semi")
    found = [
        row(many("case_id").dropDuplicates(["case_id"]), "case_id is not unique"), row(c.filter(~F.contains("text", F.col("span"))), "span not in text"), row(c.filter(~F.col("action").isin(*actions)), "unknown action"),
        row(c.filter("claim_count != claims"), "claim count differs"), row(many("__k"), "same text twice"), row(
            c.join(frozen.select(fold_key("text").alias("__k")).distinct(), "__k", "left_semi"), "text is in the frozen set"
        ),
    ]
    return reduce(DataFrame.unionByName, found)


def flatten_catalog(faculties: DataFrame) -> DataFrame:
    """(faculty_id, faculty, official_code, program, status, alias) of rows with nested programs; one row for each alias, null without."""
    p = faculties.select("faculty_id", F.col("display_name").alias("faculty"), F.explode_outer("programs").alias("p"))
    return p.select(
        "faculty_id", "faculty", F.col("p.official_code").alias("official_code"), F.col("p.display_name").alias("program"),
        F.col("p.faculty_assignment_status").alias("status"), F.explode_outer("p.aliases").alias("alias")
    )


def catalog_violations(flat: DataFrame, used: DataFrame, sources: DataFrame) -> DataFrame:
    """(item, rule): codes of several programs, and sources that are used but not registered."""
    codes = flat.filter("official_code is not null").groupBy("official_code").agg(F.count_distinct("program").alias("n")).filter("n > 1").select(F.col("official_code").alias("item"), F.lit("code is not unique").alias("rule"))
    return codes.unionByName(
        used.join(sources, "source_ref", "left_anti").select(F.col("source_ref").alias("item"), F.lit("unknown source").alias("rule"))
    )


def field_distribution(flat: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n): how often each value of the fields occurs, null too."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    return flat.select(pairs).select("p.field", "p.value").groupBy("field", "value").agg(F.count("*").alias("n"))


def category_tags(flat: DataFrame, tags: dict[str, Column]) -> DataFrame:
    """``flat`` with ``tags``: the names of the conditions that hold, in the order given."""
    return flat.withColumn("tags", F.array_compact(F.array(*[F.when(test, name) for name, test in tags.items()])))


def pack_manifest(pack: DataFrame) -> DataFrame:
    """One row about a :func:`gold_pack`: rows, notices, accepted rows and candidates."""
    return pack.agg(
        F.count("*").alias("rows"), F.count_distinct("notice_id").alias("notices"),
        F.count_if(F.col("state") == "accepted").alias("accepted"), F.count_if(F.col("state") == "candidate").alias("candidates")
    )


def catalog_status(flat: DataFrame) -> DataFrame:
    """(status, programs): programs of a flattened catalog by their faculty's assignment status, each code and name once."""
    return flat.filter("program is not null").select(
        "status", "official_code", "program"
    ).distinct().groupBy("status").agg(F.count("*").alias("programs"))


def unverified_sources(programs: DataFrame, sources: DataFrame, official: tuple[str, ...] = ("official",)) -> DataFrame:
    """(item, rule) of programs (official_code, status, source_ref) that are called verified without an official source (source_ref, source_type)."""
    good = sources.filter(F.col("source_type").isin(*official)).select("source_ref")
    backed = programs.join(good, "source_ref", "left_semi").select("official_code").distinct()
    bad = programs.filter("status = 'verified'").select("official_code").distinct().join(backed, "official_code", "left_anti")
    return bad.select(F.col("official_code").alias("item"), F.lit("verified without official source").alias("rule"))


def resolve_alias(names: DataFrame, flat: DataFrame) -> DataFrame:
    """``names`` (name) with the code and program whose own name or an alias is the same after folding; null without, the least code of several."""
    known = flat.select(F.explode(F.array_compact(F.array("program", "alias"))).alias("n"), "official_code", "program")
    known = known.groupBy(fold_key("n").alias("__k")).agg(F.min(F.struct("official_code", "program")).alias("r"))
    return names.withColumn("__k", fold_key("name")).join(known, "__k", "left").select(*names.columns, "r.official_code", "r.program")
