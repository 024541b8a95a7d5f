"""Personal feeds: who an obligation applies to, whether it is open, briefs, and the order of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herald.functions.text import ZONE

#: Profile dimensions and the audience lists they are looked up in (fixed values).
DIMENSIONS = (("faculty", "faculties"), ("major", "majors"), ("cohort", "cohorts"), ("program", "programs"))


def applicability(audience: Column, profile: dict[str, Column]) -> Column:
    """APPLIES, DOES_NOT_APPLY or UNKNOWN of a profile to an audience struct.

    No audience or none named is unknown; one for all applies. A named
    dimension that the profile has but does not fit rules it out, even if
    another is missing; a missing one leaves it unknown. Names match exactly.
    """
    named = {p: (F.size(F.coalesce(audience[a], F.expr("cast(array() as array<string>)"))) > 0) for p, a in DIMENSIONS}
    fits = {p: F.array_contains(audience[a], profile[p]) for p, a in DIMENSIONS}
    miss = wrong = some = F.lit(False)
    for p, _ in DIMENSIONS:
        some = some | named[p]
        wrong = wrong | (named[p] & profile[p].isNotNull() & ~F.coalesce(fits[p], F.lit(False)))
        miss = miss | (named[p] & profile[p].isNull())
    return (F.when(audience.isNull(), "UNKNOWN").when(F.coalesce(audience["applies_to_all_students"], F.lit(False)), "APPLIES")
            .when(~some, "UNKNOWN").when(wrong, "DOES_NOT_APPLY").when(miss, "UNKNOWN").otherwise("APPLIES"))


def _bound(value: Column, precision: Column, end: bool) -> Column:
    """UTC instant of a local date (its start, or with ``end`` the next midnight) or of a date and time."""
    day = F.try_to_date(F.left(value, F.lit(10)), "yyyy-MM-dd")
    midnight = F.to_utc_timestamp((F.date_add(day, 1) if end else day).cast("timestamp"), ZONE)
    return F.when(precision == "date", midnight).when(precision == "datetime", F.try_to_timestamp(value))


def actionability(
    deadline: Column, deadline_precision: Column, start: Column, start_precision: Column, end: Column, end_precision: Column, now: Column
) -> Column:
    """UPCOMING, ACTIVE, EXPIRED, NO_DEADLINE or UNKNOWN at ``now``.

    A date lasts through its local day and is over from the next midnight; a
    date and time is over strictly after it. A start after the end, or a value
    that cannot be read, is unknown.
    """
    last, last_p = F.coalesce(end, deadline), F.when(end.isNotNull(), end_precision).otherwise(deadline_precision)
    from_, until = _bound(start, start_precision, False), _bound(last, last_p, True)
    over = F.when(last_p == "date", now >= until).otherwise(now > until)
    unread = (start.isNotNull() & from_.isNull()) | (last.isNotNull() & until.isNull())
    return (F.when(unread, "UNKNOWN").when(from_ > until, "UNKNOWN").when(from_.isNotNull() & (now < from_), "UPCOMING")
            .when(last.isNull(), "NO_DEADLINE").when(over, "EXPIRED").otherwise("ACTIVE"))


def missing_information(obligation: dict[str, Column]) -> Column:
    """Names of the parts that a brief lacks, in order."""
    return F.array_compact(F.array(*[F.when(c.isNull(), n) for n, c in obligation.items()]))


def feed_by_class(profiles: DataFrame, obligations: DataFrame, now: Column) -> DataFrame:
    """The four dimensions, obligation_id, applicability, actionability, missing, position: the feed of each distinct profile.

    Profiles of equal dimensions see the same feed, so the result has a row for
    each of these classes and current obligation, however many profiles there
    are. ``obligations``: obligation_id, audience struct, deadline,
    deadline_precision, start, start_precision, end, end_precision, amount,
    location, validity. Items that apply come first, then those with a
    deadline, else by obligation_id.
    """
    keys = [p for p, _ in DIMENSIONS]
    kinds = profiles.select(*keys).distinct()
    live = obligations.filter(F.coalesce("validity", F.lit("CURRENT")) != "SUPERSEDED_OUTDATED")
    c = F.col
    # what does not depend on the profile is worked out once for each obligation
    live = live.select(
        "obligation_id", "audience", actionability(
            c("deadline"), c("deadline_precision"), c("start"), c("start_precision"), c("end"), c("end_precision"), now
        ).alias("actionability"),
        missing_information({"deadline": c("deadline"), "amount": c("amount"), "location": c("location")}).alias("missing"), c("deadline").isNotNull().alias("dated"))
    item = live.join(kinds, F.lit(True), "inner").withColumn("applicability", applicability(c("audience"), {k: c(k) for k in keys}))
    w = Window.partitionBy(*keys).orderBy((c("applicability") != "APPLIES").cast("int"), (~c("dated")).cast("int"), "obligation_id")
    return item.select(*keys, "obligation_id", "applicability", "actionability", "missing", F.row_number().over(w).alias("position"))


def for_profiles(profiles: DataFrame, by_class: DataFrame) -> DataFrame:
    """``profile_id`` and what ``by_class`` (the four dimensions, others) has for the profile's class."""
    keys = [p for p, _ in DIMENSIONS]
    named = by_class.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & profiles[k].eqNullSafe(named[f"__{k}"])
    rest = [c for c in by_class.columns if c not in keys]
    return profiles.select("profile_id", *keys).join(named, same).select("profile_id", *rest)


def feed(profiles: DataFrame, obligations: DataFrame, now: Column) -> DataFrame:
    """(profile_id, obligation_id, applicability, actionability, missing, position) of every profile: :func:`feed_by_class` spread out."""
    return for_profiles(profiles, feed_by_class(profiles, obligations, now))


def action_brief(items: DataFrame, obligations: DataFrame) -> DataFrame:
    """Items with what a brief shows of their obligation: action, deadline, amount, location, documents, and what is missing."""
    shown = [c for c in ("action_type", "action_text", "deadline", "amount", "location", "documents") if c in obligations.columns]
    return items.join(obligations.select("obligation_id", *shown), "obligation_id")


def visible_groups(items: DataFrame, by: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """Items of each profile, or class of profiles, by applicability, without expired ones."""
    return items.filter("actionability != 'EXPIRED'").groupBy(*by, "applicability").agg(F.count("*").alias("items"))
