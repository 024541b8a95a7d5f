"""Evaluation over labelled sets: retrieval, confusion, atoms, values, alignment, leakage, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herald.functions.text import fold_key, norm_text
from herald.operators.sift import bits_for, sift
from herald.sources.scratch import written


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """``a / b``; ``empty`` where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def prf(tp: Column, fp: Column, fn: Column, empty: float | None = 0.0) -> Column:
    """struct(precision, recall, f1) of counts; ``empty`` where a denominator is 0."""
    p, r = ratio(tp, tp + fp, empty), ratio(tp, tp + fn, empty)
    return F.struct(
        p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(empty).cast("double")).alias("f1")
    )


def derive_queries(obligations: DataFrame) -> DataFrame:
    """Up to four retrieval queries for each obligation: the action, with audience, with deadline, with a paper."""
    a = F.col("action_text")
    with_ = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(" ", a, F.col(c)))
    kinds = F.array(
        *[
            F.when(q.isNotNull(), F.struct(F.lit(k).alias("kind"), q.alias("text"))) for k,
            q in (
                ("action", a), ("audience", with_("audience_text")), ("deadline", with_("deadline_text")),
                ("document", with_("document_text"))
            )
        ]
    )
    return obligations.select("obligation_id", F.explode(F.array_compact(kinds)).alias("q")).select("obligation_id", "q.kind", "q.text")


def retrieval_metrics(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, item: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: queries, hit rate and recall at each k, and mean reciprocal rank, by the first relevant item."""
    hit = ranked.join(relevant, ["query_id", item])
    first = hit.groupBy("query_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"__{k}") for k in ks])
    total = relevant.groupBy("query_id").agg(F.count("*").alias("__all"))
    j = queries.select("query_id").join(first, "query_id", "left").join(total, "query_id", "left")
    at = [F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks]
    rec = [F.avg(F.coalesce(F.col(f"__{k}") / F.col("__all"), F.lit(0.0))).alias(f"recall_{k}") for k in ks]
    return j.agg(F.count("*").alias("queries"), *at, *rec, F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def mutate_cases(cases: DataFrame) -> DataFrame:
    """Four variants of each case (case_id, text, deadline, location): exact, deadline four days on, another place, unsupported."""
    later = F.date_format(F.date_add(F.col("deadline").cast("date"), 4), "yyyy-MM-dd")
    kinds = F.array(
        F.struct(
            F.lit("exact").alias("mutation"), F.col("deadline").alias("deadline"), F.col("location").alias("location"),
            F.lit("VERIFIED").alias("expected")
        ),
        *[F.struct(F.lit(k).alias("mutation"), d.alias("deadline"), p.alias("location"), F.lit(v).alias("expected")) for k, d, p, v in (
            ("deadline", later, F.col("location"), "CONFLICT"), (
                "location", F.col("deadline"), F.lit("another place"), "INSUFFICIENT_EVIDENCE"
            ),
            ("unsupported", F.lit(None).cast("string"), F.lit(None).cast("string"), "ABSTAINED"))])
    return cases.select("case_id", F.explode(kinds).alias("m")).select("case_id", "m.*")


def confusion_prf(rows: DataFrame, labels: list) -> DataFrame:
    """(label, support, precision, recall, f1) of rows (truth, predicted): null rates without support; every label is there."""
    spark = rows.sparkSession
    counts = rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    sides = F.explode(F.array_distinct(F.array(F.col("truth"), F.col("predicted")))).alias("label")
    per = counts.select("truth", "predicted", "n", sides).groupBy("label").agg(
        F.sum(F.when((F.col("truth") == F.col("label")) & (F.col("predicted") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("truth") != F.col("label")) & (F.col("predicted") == F.col("label")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("truth") == F.col("label")) & (F.col("predicted") != F.col("label")), F.col("n")).otherwise(0)).alias("fn"))
    domain = spark.createDataFrame([(x,) for x in labels], f"label {rows.schema['truth'].dataType.simpleString()}")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    s = prf(z("tp"), z("fp"), z("fn"), 0.0)
    some = z("tp") + z("fn") > 0
    return domain.join(per, "label", "left").select(
        "label", (z("tp") + z("fn")).alias("support"), *[F.when(some, s[m]).alias(m) for m in ("precision", "recall", "f1")]
    )


def macro_average(per_label: DataFrame) -> DataFrame:
    """One row: labels with support, and the means of their precision, recall and f1 of :func:`confusion_prf`."""
    some = per_label.filter("support > 0")
    return some.agg(F.count("*").alias("labels"), *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")])


def stale_hits(ranked: DataFrame, current: DataFrame, item: str) -> DataFrame:
    """One row: listed hits, and how many of them are not in ``current``."""
    known = current.select(item).distinct().withColumn("__c", F.lit(True))
    j = ranked.join(known, item, "left")
    return j.agg(F.count("*").alias("hits"), F.count_if(F.col("__c").isNull()).alias("stale"))


def exact_match(gold: DataFrame, predicted: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(field, notices, present, exact_all, exact_present, errors) of sets of values (notice_id, field, value): deadline and money.

    Each notice of ``gold`` counts for every field it lists, a null value for
    none; ``predicted`` has ``error`` set where the extraction failed, which
    counts as wrong. Notices of ``exclude`` (notice_id), such as the examples
    shown to a model, are left out. The shares are over all notices and over
    those with a value.
    """
    key = ["notice_id", "field"]
    side = lambda df, name: df.groupBy(*key).agg(F.array_sort(F.collect_set("value")).alias(name))
    g = gold if exclude is None else gold.join(exclude.select("notice_id").distinct(), "notice_id", "left_anti")
    failed = predicted.groupBy("notice_id").agg(F.max(F.col("error").isNotNull()).alias("failed"))
    j = side(g, "g").join(side(predicted, "p"), key, "left").join(failed, "notice_id", "left")
    none = F.expr("cast(array() as array<string>)")
    failed_ = F.coalesce("failed", F.lit(False))
    same, some = ~failed_ & (F.coalesce("p", none) == F.col("g")), F.size("g") > 0
    out = j.groupBy("field").agg(
        F.count("*").alias("notices"), F.count_if(some).alias("present"), F.count_if(same).alias("a"), F.count_if(same & some).alias("b"),
        F.count_if(failed_).alias("errors")
    )
    return out.select(
        "field", "notices", "present", ratio(F.col("a"), F.col("notices"), 0.0).alias("exact_all"),
        ratio(F.col("b"), F.col("present"), 0.0).alias("exact_present"), "errors"
    )


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: rows, those right, and their share."""
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("right")
    ).withColumn("accuracy", ratio(F.col("right"), F.col("n")))


def error_layers(rows: DataFrame) -> DataFrame:
    """(layer, n): each wrong case by the first stage that failed: segmentation, extraction, retrieval, comparison, verdict."""
    layer = (F.when(F.col("truth") == F.col("predicted"), "right").when(~F.col("segmented"), "segmentation").when(~F.col("extracted"), "extraction")
             .when(~F.col("retrieved"), "retrieval").when(~F.col("compared"), "comparison").otherwise("verdict"))
    return rows.groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


def atom_prf(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(field, tp, fp, fn, precision, recall, f1) of distinct atoms (notice_id, field, atom), summed over notices; 0 where nothing is."""
    key = ["notice_id", "field", "atom"]
    norm = lambda df, side: df.select("notice_id", "field", norm_text("atom").alias("atom")).distinct().withColumn(side, F.lit(1))
    both = norm(gold, "g").join(norm(predicted, "p"), key, "full_outer")
    c = both.groupBy("field").agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn")
    )
    return c.select("*", prf(F.col("tp"), F.col("fp"), F.col("fn")).alias("s")).select("field", "tp", "fp", "fn", "s.*")


def value_metrics(expected: DataFrame, predicted: DataFrame, key: str = "record_id") -> DataFrame:
    """(field, status, support_n, matched_n, predicted_value_n, precision, recall, f1) of values by field.

    ``expected``: key, field, value, one row a record and field, of null value
    where nothing is expected. ``predicted``: key, field, value, any number of
    rows, repeated ones too. An expected value is matched if it is among the
    record's predicted ones; precision is to all predicted values of the field.
    A field without expected values is not measured, and its figures are null.
    """
    given = predicted.filter("value is not null").groupBy(key, "field").agg(
        F.count("*").alias("n"), F.collect_set("value").alias("values"))
    j = expected.join(given, [key, "field"], "left")
    counts = j.groupBy("field").agg(
        F.count("value").alias("support_n"), F.count_if(F.array_contains("values", F.col("value"))).alias("matched_n"),
        F.sum(F.coalesce("n", F.lit(0))).alias("predicted_value_n"))
    measured = F.col("support_n") > 0
    precision, recall = ratio(F.col("matched_n"), F.col("predicted_value_n")), ratio(F.col("matched_n"), F.col("support_n"))
    f1 = F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall)).otherwise(0.0)
    only = lambda c: F.when(measured, c)
    return counts.select(
        "field", F.when(measured, "MEASURED").otherwise("NOT_YET_MEASURED").alias("status"), "support_n", only(F.col("matched_n")).alias("matched_n"),
        only(F.col("predicted_value_n")).alias("predicted_value_n"), only(precision).alias("precision"), only(recall).alias("recall"), only(f1).alias("f1"))


def running(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before, in a total order.

    Rows are dealt to ranges, each summed by itself, and the ranges' totals are
    summed in turn: no task gets more than a range.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__p").agg(F.sum(value).alias("__t"))
    base = totals.select("__p", F.coalesce(F.sum("__t").over(
        Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # a row for each range
    own = F.sum(value).over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("__o", F.coalesce(own, F.lit(0))).join(base, "__p").withColumn(name, F.col("__b") + F.col("__o")).drop("__p", "__o", "__b")


def align_claims(gold: DataFrame, predicted: DataFrame, per_case: bool = True) -> DataFrame:
    """Gold and predicted claims (case_id, ix, text, others) side by side by their number: within the case, or over all cases in order.

    ``gold`` and ``predicted`` are structs of a claim's columns. Over all cases
    a claim's number is its place in its case and the claims of the cases
    before, which are summed by case.
    """
    def numbered(claims: DataFrame, name: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("case_id").orderBy("ix"))
        rows = claims.withColumn("n", n.cast("long"))
        if not per_case:
            before = running(claims.groupBy("case_id").agg(F.count("*").alias("c")), ["case_id"], "c", "before").drop("c")
            rows = rows.join(before, "case_id").withColumn("n", F.col("n") + F.col("before"))
        return rows.select(*(["case_id"] if per_case else []), "n", F.struct(*claims.columns).alias(name))

    return numbered(gold, "gold").join(numbered(predicted, "predicted"), ["case_id", "n"] if per_case else ["n"], "full_outer")


def claim_metrics(gold: DataFrame, predicted: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: claim count and boundary accuracy over ``cases`` (case_id), and claims missed and invented in all.

    ``gold`` and ``predicted``: case_id, ix, text. A case's boundaries are
    right if it has as many claims as it should and each has the text it should.
    """
    aligned = align_claims(gold.select("case_id", "ix", "text"), predicted.select("case_id", "ix", "text"))
    by_case = aligned.groupBy("case_id").agg(
        F.count("gold").alias("g"), F.count("predicted").alias("p"),
        F.count_if(F.coalesce(F.col("gold.text") == F.col("predicted.text"), F.lit(False))).alias("same"))
    j = cases.select("case_id").join(by_case, "case_id", "left").fillna(0, ["g", "p", "same"])
    out = j.agg(
        F.count("*").alias("n"), F.count_if(F.col("g") == F.col("p")).alias("counted"),
        F.count_if((F.col("g") == F.col("p")) & (F.col("same") == F.col("g"))).alias("bounded"), F.coalesce(F.sum("g"), F.lit(0)).alias("expected"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("observed"))
    most = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    return out.select(
        "n", ratio(F.col("counted"), F.col("n")).alias("claim_count_accuracy"), ratio(F.col("bounded"), F.col("n")).alias("claim_boundary_accuracy"),
        most("expected", "observed").alias("missed_claims"), most("observed", "expected").alias("hallucinated_claims"))


def field_scores(gold: DataFrame, predicted: DataFrame, fields: list[str], per_case: bool = False) -> DataFrame:
    """(field, support_n, precision, recall, f1, value_accuracy, span_accuracy) of aligned claims' fields.

    ``gold``: case_id, ix, text and a column for each field; ``predicted``:
    case_id, ix and for each field its value and ``<field>_text``. By the
    number over all cases, as the reference counts, or within each case. Equal
    values are right; another or missing one counts against recall, an
    unexpected one against precision. A right value's span is exact if the gold
    claim's text holds its words. Without support the figures are null, f1 0.
    """
    aligned = align_claims(gold, predicted, per_case).filter("gold is not null")
    rows = aligned.select(F.explode(F.array(*[
        F.struct(
            F.lit(f).alias("field"), F.col(f"gold.{f}").cast("string").alias("want"), F.col(f"predicted.{f}").cast("string").alias("got"),
            F.contains("gold.text", F.col(f"predicted.{f}_text")).alias("held")) for f in fields])).alias("x")).select("x.*")
    tp, support = F.col("want") == F.col("got"), F.col("want").isNotNull()
    c = rows.groupBy("field").agg(
        F.count("want").alias("support_n"), F.count_if(tp).alias("tp"), F.count_if(support & ~F.coalesce(tp, F.lit(False))).alias("fn"),
        F.count_if(~support & F.col("got").isNotNull()).alias("fp"), F.count_if(tp & F.coalesce("held", F.lit(False))).alias("spans"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return c.select(
        "field", "support_n", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        ratio(F.col("tp"), F.col("support_n")).alias("value_accuracy"), ratio(F.col("spans"), F.col("support_n")).alias("span_accuracy"))


def field_outcomes(rows: DataFrame, exact: bool = False) -> DataFrame:
    """(field, outcome, n) of rows (field, gold, predicted): correct, incorrect, missing, hallucinated or absent.

    Values are correct if they are equal by :func:`norm_text`; with ``exact``,
    for values that are normalised already, only if they are equal as they are.
    """
    value = F.col if exact else norm_text
    o = F.when(F.col("gold").isNull() & F.col("predicted").isNull(), "absent").when(F.col("gold").isNull(), "hallucinated").when(
        F.col("predicted").isNull(), "missing").when(value("gold") == value("predicted"), "correct").otherwise("incorrect")
    return rows.groupBy("field", o.alias("outcome")).agg(F.count("*").alias("n"))


#: Fields that a model's claims are qualified by; the last is a list.
QUALIFIED = ("action", "deadline", "amount", "audience", "required_documents")


def claim_outcomes(gold: DataFrame, returned: DataFrame) -> DataFrame:
    """(field, outcome, n) of a model's claims against gold claims of the same number: case_id, ix and the columns of ``QUALIFIED``.

    Values are compared as they are; papers as a multiset, folded. An empty
    list is no value. Claims beyond the gold ones are not looked at here.
    """
    papers = lambda c: F.array_join(F.array_sort(F.transform(c, fold_key)), "\x00")
    listed = lambda c: F.when(F.size(c) > 0, papers(c))
    rows = align_claims(gold, returned).filter("gold is not null")
    each = [
        F.struct(F.lit(f).alias("field"), *[
            (listed(F.col(f"{side}.{f}")) if f == QUALIFIED[-1] else F.col(f"{side}.{f}").cast("string")).alias(side) for side in ("gold", "predicted")])
        for f in QUALIFIED]
    return field_outcomes(rows.select(F.explode(F.array(*each)).alias("x")).select("x.*"), exact=True).filter("outcome != 'absent'")


def qualification(cases: DataFrame, gold: DataFrame, returned: DataFrame) -> DataFrame:
    """One row of counts and ``status`` of a model's outputs.

    ``cases``: case_id and ``error``, null where the output was accepted (see
    :func:`herald.operators.obligations.payload_errors`). ``gold`` and
    ``returned`` as in :func:`claim_outcomes`; claims of a failed output are
    not counted as missing, but expected. Any failure or violation blocks; any
    missing or unexpected claim, and any field that is not as it should, is for
    review; else the model is qualified for these fields.
    """
    good = cases.filter("error is null").select("case_id")
    count = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    by_case = cases.join(count(gold, "g"), "case_id", "left").join(count(returned.join(good, "case_id", "left_semi"), "r"), "case_id", "left")
    ok, error = F.isnull("error"), F.coalesce("error", F.lit(""))
    g, r = F.coalesce("g", F.lit(0)), F.coalesce("r", F.lit(0))
    over = lambda a, b: F.coalesce(F.sum(F.when(ok, F.greatest(a - b, F.lit(0)))), F.lit(0))
    invented, loose = error == "INVENTED_YEAR", error.contains("UNGROUNDED")
    n = by_case.agg(
        F.count("*").alias("sample_count"), F.coalesce(F.sum(g), F.lit(0)).alias("expected_claim_count"),
        F.coalesce(F.sum(F.when(ok, r)), F.lit(0)).alias("returned_claim_count"), over(g, r).alias("missing_claims"), over(r, g).alias("unexpected_claims"),
        F.count_if(ok).alias("adapter_success_count"), F.count_if(~ok).alias("adapter_failure_count"),
        F.count_if(~ok & ~invented & ~loose).alias("invalid_output_count"), F.count_if(loose).alias("grounding_violation_count"),
        F.count_if(invented).alias("invented_year_violation_count"), F.count_if(error == "INVALID_ACTION").alias("invalid_action_violation_count"))
    wrong = claim_outcomes(gold.join(good, "case_id", "left_semi"), returned.join(good, "case_id", "left_semi")).agg(
        F.coalesce(F.sum(F.when(F.col("outcome") != "correct", F.col("n"))), F.lit(0)).alias("field_mismatches"))
    status = F.when(F.col("adapter_failure_count") > 0, "QUALIFICATION_BLOCKED").when(
        F.col("missing_claims") + F.col("unexpected_claims") + F.col("field_mismatches") > 0, "MEASURED_REQUIRES_HUMAN_REVIEW"
    ).otherwise("QUALIFIED_FOR_EVALUATED_FIELDS_ONLY")
    return n.join(wrong, F.lit(True)).withColumn("status", status)  # one row each


def leakage(cases: DataFrame, frozen: DataFrame) -> DataFrame:
    """Cases (case_id, text) whose folded text stands in the frozen set (text)."""
    return cases.join(
        frozen.select(fold_key("text").alias("__k")).distinct(), fold_key(cases["text"]) == F.col("__k"), "left_semi"
    ).select("case_id")


def contained(passages: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """(item_id, doc_id) of passages that a document holds word for word, folded.

    Candidates hold all windows of ``k`` words of the passage; passages of
    fewer words are one window of their own length. Documents are read once and
    cut into windows where they are read; a table of bits of the passages'
    windows, of bounded size, rules out nearly all others before any shuffle,
    and only candidates' texts are looked through. A passage without words is
    in no document; null texts have no words.
    """
    words = lambda c: F.filter(F.split(fold_key(c), " "), lambda x: x != F.lit(""))
    grams = lambda w, n: F.transform(
        F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(n, F.array_join(F.slice(w, i, n), " "))
    )
    p = passages.select("item_id", fold_key("text").alias("p"), words("text").alias("w")).filter(F.size("w") > 0)
    p = p.withColumn("n", F.least(F.size("w"), F.lit(k)))
    g = written(p.select("item_id", F.explode(F.array_distinct(grams(F.col("w"), F.col("n")))).alias("h")), "windows")
    sizes = p.select("n").distinct()  # at most k rows
    d = documents.select("doc_id", words("text").alias("w")).join(F.broadcast(sizes), F.size("w") >= F.col("n"))
    near = d.select("doc_id", F.explode(F.array_distinct(grams(F.col("w"), F.col("n")))).alias("h"))
    near = sift(near, "h", g.select("h"), bits_for(g.count()))
    all_ = g.groupBy("item_id").agg(F.count("*").alias("all"))
    pairs = near.join(g, "h").groupBy("item_id", "doc_id").agg(
        F.count_distinct("h").alias("m")
    ).join(all_, "item_id").filter("m = all").select("item_id", "doc_id")
    held = documents.select("doc_id", "text").join(pairs, "doc_id").select(
        "item_id", "doc_id", fold_key("text").alias("t")
    ).join(p.select("item_id", "p"), "item_id")
    return held.filter(
        F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), "p", F.lit(" ")))
    ).select("item_id", "doc_id").distinct()


def change_classes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, change) of outcomes (case_id, right) before and after: regression, fixed, unchanged or limitation."""
    j = before.select("case_id", F.col("right").alias("b")).join(after.select("case_id", F.col("right").alias("a")), "case_id")
    return j.select(
        "case_id",
        F.when(
            F.col("b") & ~F.col("a"), "regression"
        ).when(~F.col("b") & F.col("a"), "fixed").when(F.col("a"), "unchanged").otherwise("limitation").alias("change")
    )


def distribution(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(value, n) with every value of the domain, 0 where it does not occur."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return rows.sparkSession.createDataFrame([(d,) for d in domain], "value string").join(counts, "value", "left").select(
        "value", F.coalesce("n", F.lit(0)).alias("n")
    )


def order_statistics(rows: DataFrame, column: str, share: float, linear: bool, accuracy: int = 10_000) -> DataFrame:
    """One row (n, value): the value at ``share`` of the ascending values, exactly.

    By linear interpolation between ranks, else the value at index ``int(share
    * n)``. Approximate quantiles bracket the ranks, so that only what lies
    between two of them, some ten-thousandths of all, is put in order. Null
    values are left out; without values it is null.
    """
    v = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    slack = 3.0 / accuracy
    low, high = max(0.0, share - slack), min(1.0, share + slack)
    ends = F.percentile_approx("v", F.array(F.lit(low), F.lit(high)), F.lit(accuracy))
    frame = v.agg(F.count("*").alias("n"), ends.alias("e"), F.min("v").alias("least"), F.max("v").alias("most"))
    # one row, joined to all
    few = F.col("n") < 2 * accuracy  # ranks of so few lie too far apart for the bracket
    lower, upper = F.when(
        few | F.lit(low == 0), F.col("least")
    ).otherwise(F.col("e")[0]), F.when(few | F.lit(high == 1), F.col("most")).otherwise(F.col("e")[1])
    frame = frame.select("n", lower.alias("a"), upper.alias("b"))
    marked = v.join(F.broadcast(frame), F.lit(True))
    below = marked.filter("v < a").agg(F.count("*").alias("below"))
    inner = marked.filter("v between a and b").groupBy("v", "n").agg(F.count("*").alias("c"))
    inner = running(inner, ["v"], "c", "upto").withColumn("upto", F.col("upto") + F.col("c")).join(
        F.broadcast(below), F.lit(True)).withColumn("upto", F.col("upto") + F.col("below"))  # one row
    at = (F.col("n") - 1) * F.lit(share) if linear else F.least(F.floor(F.col("n") * F.lit(share)), F.col("n") - 1)
    pick = inner.withColumn("at", at)
    found = pick.agg(
        F.max("at").alias("at"), F.max("n").alias("n"), F.min(F.when(F.col("upto") > F.floor("at"), F.col("v"))).alias("x"),
        F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("y")
    )
    return found.select(
        F.coalesce("n", F.lit(0)).alias("n"), (F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.floor("at"))).alias("value")
    )


def percentiles(rows: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, p50 and p95 by linear interpolation."""
    p50, p95 = (order_statistics(rows, column, s, True).select(F.col("value").alias(n)) for s, n in ((0.5, "p50"), (0.95, "p95")))
    return rows.agg(F.count(column).alias("n"), F.avg(column).alias("mean")).crossJoin(p50).crossJoin(p95)  # one row each


def percentile_at(rows: DataFrame, column: str, share: float) -> DataFrame:
    """One row: the value at index ``int(share * n)`` of the ascending values."""
    return order_statistics(rows, column, share, False).select("value")


def expand_gold(records: DataFrame) -> DataFrame:
    """One row for each gold claim of accepted records (record_id, state, gold_claims, gold_claim): the list, the one if that is null or empty."""
    r = records.filter("state = 'accepted'")
    return r.select("record_id", F.posexplode(F.when(F.size("gold_claims") > 0, F.col("gold_claims")).otherwise(F.array("gold_claim"))).alias("ix", "claim"))


def candidate_claims(obligations: DataFrame) -> DataFrame:
    """Claims to try against each obligation (obligation_id, deadline, amount, audience, location, document): one exact, and one for each field made wrong."""
    c = F.col
    later = F.date_format(F.date_add(c("deadline").cast("date"), 4), "yyyy-MM-dd")
    base = {
        "deadline": c("deadline"), "amount": c("amount").cast("bigint"), "audience": c("audience"), "location": c("location"),
        "document": c("document")
    }
    wrong = {
        "deadline": later, "amount": base["amount"] + 500_000, "audience": F.lit("another audience"), "location": F.lit("another place"),
        "document": F.lit("another document")
    }
    kinds = [F.struct(F.lit("exact").alias("mutation"), *[v.alias(k) for k, v in base.items()])]
    kinds += [
        F.when(
            base[f].isNotNull(), F.struct(F.lit(f).alias("mutation"), *[(wrong[k] if k == f else v).alias(k) for k, v in base.items()])
        ) for f in base
    ]
    return obligations.select(
        "obligation_id", F.explode(F.array_compact(F.array(*kinds))).alias("m")
    ).select("obligation_id", "m.*", F.lit("CANDIDATE").alias("status"))


def field_accuracy(rows: DataFrame) -> DataFrame:
    """(field, n, right, accuracy) of rows (field, expected, state)."""
    out = rows.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("expected").eqNullSafe(F.col("state"))).alias("right"))
    return out.withColumn("accuracy", ratio(F.col("right"), F.col("n")))
