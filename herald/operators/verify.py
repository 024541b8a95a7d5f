"""Claims against reviewed obligations: field comparison, choice of obligation, verdicts, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herald.functions.text import date_iso, digits

MATCH, CONFLICT, INSUFFICIENT = "MATCH", "CONFLICT", "INSUFFICIENT_EVIDENCE"


def compare_deadline(claimed: Column, claimed_norm: Column, official: Column, official_norm: Column) -> Column:
    """MATCH or CONFLICT of two calendar dates; INSUFFICIENT_EVIDENCE where either is none.

    A reviewed normalized date stands for the official text, cut to its day.
    """
    claim, off = F.coalesce(claimed_norm, date_iso(claimed)), date_iso(F.coalesce(official_norm, official))
    return F.when(claim.isNull() | off.isNull(), INSUFFICIENT).when(claim == off, MATCH).otherwise(CONFLICT)


def compare_amount(claimed: Column, claimed_value: Column, official: Column) -> Column:
    """MATCH of two equal sums of 0 or more, else CONFLICT."""
    value = F.coalesce(claimed_value, digits(F.coalesce(claimed, F.lit(""))))
    return F.when((value == digits(official.cast("string"))) & (value >= 0), MATCH).otherwise(CONFLICT)


def compare_action(claimed: Column, claimed_type: Column, official_type: Column) -> Column:
    """MATCH of the types; without a claimed type the wording decides for three of them."""
    text = F.lower(claimed)
    lexical = ((official_type == "pay") & F.contains(text, F.lit("đóng"))) | (
        (official_type == "register") & F.contains(text, F.lit("đăng ký"))
    ) | ((official_type == "submit") & F.contains(text, F.lit("nộp")))
    return F.when(F.when(claimed_type.isNotNull(), claimed_type == official_type).otherwise(lexical), MATCH).otherwise(CONFLICT)


def compare_audience(official_all: Column) -> Column:
    """MATCH if the notice is for all, else INSUFFICIENT_EVIDENCE; no verdict rests on it."""
    return F.when(F.coalesce(official_all, F.lit(False)), MATCH).otherwise(INSUFFICIENT)


def compare_location(claimed: Column, official: Column) -> Column:
    """MATCH of equal places whatever their case; a URL is no place. No verdict rests on it."""
    url = F.contains(claimed, F.lit("http")) & ~F.contains(official, F.lit("http"))
    return F.when(url, CONFLICT).when(F.lower(F.trim(claimed)) == F.lower(F.trim(official)), MATCH).otherwise(CONFLICT)


def evaluate(pairs: DataFrame) -> DataFrame:
    """Field states of rows that pair a claim with an obligation.

    ``pairs`` has action_text, action_type, deadline_text, deadline_norm,
    amount_text, amount_value of the claim and off_action, off_deadline,
    off_deadline_norm, off_amount of the obligation. Without a matching action
    on both sides nothing else is compared and the pair is unusable. Adds
    action_state, deadline_state, amount_state, match_count,
    comparable_count and signature.
    """
    c = F.col
    acts = c("action_type").isNotNull() & c("off_action").isNotNull()
    act = F.when(acts & (compare_action(c("action_text"), c("action_type"), c("off_action")) == MATCH), MATCH)
    # the official day is read once for each pair, and states once each
    out = pairs.withColumns({"action_state": act, "__off_day": date_iso(F.coalesce("off_deadline_norm", "off_deadline"))})
    acted, off = c("action_state").isNotNull(), c("__off_day")
    claimed = compare_deadline(c("deadline_text"), c("deadline_norm"), off, off)
    day = F.when(acted & c("deadline_text").isNotNull(), F.when(c("deadline_norm").isNotNull(), claimed).otherwise(INSUFFICIENT))
    sum_ = F.when(
        acted & c("amount_text").isNotNull(),
        F.when(c("off_amount").isNotNull(), compare_amount(c("amount_text"), c("amount_value"), c("off_amount"))).otherwise(INSUFFICIENT))
    out = out.withColumns({"deadline_state": day, "amount_state": sum_})
    states = [c(f"{f}_state") for f in ("action", "deadline", "amount")]
    count = lambda test: sum((F.when(F.coalesce(test(s), F.lit(False)), 1).otherwise(0) for s in states), F.lit(0))
    signature = F.concat_ws(
        "|", states[0], F.when(acted, c("off_action")), states[1], F.when(states[1] != INSUFFICIENT, off), states[2],
        F.when(states[2].isNotNull(), c("off_amount").cast("string")))
    counts = {"match_count": count(lambda s: s == MATCH), "comparable_count": count(lambda s: s != INSUFFICIENT)}
    return out.withColumns({**counts, "signature": signature}).drop("__off_day")


def field_verdict(states: list[Column]) -> Column:
    """CONFLICT if any field conflicts; with a match VERIFIED, PARTIALLY_VERIFIED if another field lacks evidence; else INSUFFICIENT_EVIDENCE."""
    any_ = lambda v: F.coalesce(sum((F.when(F.coalesce(s == v, F.lit(False)), 1).otherwise(0) for s in states), F.lit(0)) > 0, F.lit(False))
    return F.when(any_(CONFLICT), CONFLICT).when(
        any_(MATCH) & ~any_(INSUFFICIENT), "VERIFIED"
    ).when(any_(MATCH), "PARTIALLY_VERIFIED").otherwise(INSUFFICIENT)


def best_obligation(evaluated: DataFrame, claim: list[str], ordinal: str) -> DataFrame:
    """For each claim: n_obligations, whether one is usable, the states of the usable one of most matches, and ``ambiguous``.

    Of equal matches the first by ``ordinal``; they are ambiguous if their
    signatures differ, which the least and the greatest tell. One aggregation
    with partial results, so a claim with many obligations fills no task.
    """
    usable = F.col("comparable_count") > 0
    states = F.struct(*[f"{f}_state" for f in ("action", "deadline", "amount")])
    best = F.min(F.when(usable, F.struct((-F.col("match_count")).alias("m"), F.col(ordinal).alias("o"), states.alias("s"))))
    low = F.min(F.when(usable, F.struct((-F.col("match_count")).alias("m"), "signature")))
    high = F.max(F.when(usable, F.struct("match_count", "signature")))
    out = evaluated.groupBy(*claim).agg(F.count(ordinal).alias("n_obligations"), best.alias("best"), low.alias("low"), high.alias("high"))
    return out.select(
        *claim, "n_obligations", F.col("best").isNotNull().alias("usable"), "best.s.*",
        (F.col("low.signature") != F.col("high.signature")).alias("ambiguous")
    )


def abstention(has_field: Column, has_evidence: Column, has_obligation: Column, usable: Column, ambiguous: Column) -> Column:
    """The first reason not to judge, in order; null if there is none."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (F.when(no(has_field), "UNSUPPORTED_CLAIM_FIELD").when(no(has_evidence), "NO_RETRIEVAL_EVIDENCE")
            .when(no(has_obligation) | no(usable), "NO_OFFICIAL_FIELD").when(F.coalesce(ambiguous, F.lit(False)), "AMBIGUOUS_OFFICIAL_EVIDENCE"))


def temporal_gate(verdict: Column, validity: Column) -> Column:
    """Superseded evidence verifies only in part and conflicts not at all."""
    old = validity == "SUPERSEDED_OUTDATED"
    return F.when(old & (verdict == "VERIFIED"), "PARTIALLY_VERIFIED").when(old & (verdict == CONFLICT), INSUFFICIENT).otherwise(verdict)


def verify_claims(claims: DataFrame, obligations: DataFrame, validity: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(message_id, claim_ix, notice_id, version_id, verdict, abstention_reason, states) of claims of :func:`herald.operators.claims.extract_claims`.

    ``evidence`` names the first-ranked (notice_id, version_id) of each claim,
    and no lower-ranked one takes its place; without it the claims have these
    columns. ``obligations`` are reviewed ones (notice_id, version_id,
    ordinal, off_*), ``validity`` (notice_id, version_id, validity). The claims
    are read once.
    """
    key, version = ["message_id", "claim_ix"], ["notice_id", "version_id"]
    own = [c for c in version if evidence is None]
    flat = claims.select(
        *key, *own, F.col("action.text").alias("action_text"), F.col("action.type").alias("action_type"), F.col("deadline.text").alias("deadline_text"), F.col("deadline.normalized").alias("deadline_norm"),
        F.col("amount.text").alias("amount_text"), F.col("amount.value").alias("amount_value"))
    flat = flat.withColumn("has_field", F.coalesce("action_type", "deadline_text", "amount_text").isNotNull())
    seen = flat if evidence is None else flat.join(evidence.select(*key, *version), key, "left")
    best = best_obligation(
        evaluate(seen.join(obligations, version, "left")), [*key, *version, "has_field"], "ordinal"
    ).join(validity, version, "left")
    why = abstention(F.col("has_field"), F.col("notice_id").isNotNull(), F.col("n_obligations") > 0, F.col("usable"), F.col("ambiguous"))
    judged = temporal_gate(
        field_verdict([F.col(f"{f}_state") for f in ("action", "deadline", "amount")]), F.coalesce("validity", F.lit("CURRENT"))
    )
    return best.select(
        *key, *version, F.when(why.isNotNull(), "ABSTAINED").otherwise(judged).alias("verdict"), why.alias("abstention_reason"),
        *[F.when(why.isNull(), F.col(f"{f}_state")).alias(f"{f}_state") for f in ("action", "deadline", "amount")]
    )


def public_verdict(verdict: Column) -> Column:
    """An abstention is shown as lack of evidence."""
    return F.when(verdict == "ABSTAINED", INSUFFICIENT).otherwise(verdict)


def message_verdicts(verdicts: DataFrame) -> DataFrame:
    """(message_id, n_claims, verdict): a conflict anywhere; all verified; some verified, even in part; else lack of evidence."""
    v = public_verdict(F.col("verdict"))
    some = F.bool_or(v.isin("VERIFIED", "PARTIALLY_VERIFIED"))
    out = F.when(F.bool_or(v == CONFLICT), CONFLICT).when(
        F.bool_and(v == "VERIFIED"), "VERIFIED"
    ).when(some, "PARTIALLY_VERIFIED").otherwise(INSUFFICIENT)
    return verdicts.groupBy("message_id").agg(F.count("*").alias("n_claims"), out.alias("verdict"))


def evidence_shown(verdicts: DataFrame) -> DataFrame:
    """``evidence_visible``: there is evidence and the claim was judged; ``verified_primary``: its message is verified and this is its first claim."""
    w = Window.partitionBy("message_id")
    visible = F.col("notice_id").isNotNull() & (F.col("verdict") != "ABSTAINED")
    primary = F.min(F.col("verdict") == "VERIFIED").over(w) & (F.col("claim_ix") == F.min("claim_ix").over(w))
    return verdicts.select(
        "message_id", "claim_ix", public_verdict(F.col("verdict")).alias("public_verdict"), visible.alias("evidence_visible"),
        primary.alias("verified_primary")
    )


def temporal_validity(versions: DataFrame, relations: DataFrame) -> DataFrame:
    """(notice_id, version_id, validity) of ``versions`` (notice_id, version_id, is_latest).

    An old version is superseded. Else the first relation by relation_id that
    supersedes or amends it, or all versions of its notice (null target
    version), decides: confirmed by a person it is superseded, otherwise its
    state is unknown. ``relations``: relation_id, target_notice_id,
    target_version_id, relation_type, provenance.
    """
    edges = relations.filter(F.col("relation_type").isin("supersedes", "amends"))
    first = lambda *keys: [
        F.min(F.struct("relation_id", F.lower("provenance").isin("manual", "reviewed", "gold", "human").alias("confirmed")))
    ]
    exact = edges.filter("target_version_id is not null").groupBy(
        F.col("target_notice_id").alias("notice_id"), F.col("target_version_id").alias("version_id")
    ).agg(first()[0].alias("a"))
    wide = edges.filter("target_version_id is null").groupBy(F.col("target_notice_id").alias("notice_id")).agg(first()[0].alias("b"))
    e = versions.join(exact, ["notice_id", "version_id"], "left").join(wide, ["notice_id"], "left").withColumn("e", F.least("a", "b"))
    state = F.when(
        ~F.col("is_latest") | F.col("e.confirmed"), "SUPERSEDED_OUTDATED"
    ).when(F.col("e").isNotNull(), "UNKNOWN").otherwise("CURRENT")
    return e.select("notice_id", "version_id", state.alias("validity"))
