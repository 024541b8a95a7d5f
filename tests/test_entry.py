import __spark_entry__ as entry

from herald.operators import evaluate as J


def test_names_match():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1500 and {r.verdict for r in rows} <= {"VERIFIED", "PARTIALLY_VERIFIED", "CONFLICT", "INSUFFICIENT_EVIDENCE"}


def test_zero_support_is_null(spark):
    r = spark.createDataFrame([("a", "a"), ("a", "b")], "truth string, predicted string")
    got = {x.label: (x.support, x.precision, x.recall) for x in J.confusion_prf(r, ["a", "b", "c"]).collect()}
    assert got == {"a": (2, 1.0, 0.5), "b": (0, None, None), "c": (0, None, None)}
