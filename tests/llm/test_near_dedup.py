import random

from pyspark.sql import functions as F

from herald.llm import near_dedup as N
from tests_llm_helpers import classes_of

random.seed(5)
VOCAB = [f"w{i}" for i in range(4000)]


def text(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


def edited(t, share):
    return " ".join(random.choice(VOCAB) if random.random() < share else w for w in t.split())


def _corpus():
    rows, base = [], [text(random.randint(3, 300)) for _ in range(40)]
    hub = text(200)
    rows += base + [hub] + [edited(hub, random.choice([0.01, 0.02, 0.04])) for _ in range(60)]  # a large group round one document
    rows += [edited(b, 0.005) for b in base[:20]] + base[:10] + [None, "", " \n ", "a b", "a b", text(20000)]
    random.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_brute_force(spark):
    rows = _corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    want = classes_of(rows)
    assert len(got) == len(rows)
    # a pair at the very threshold may be missed, but no more than that
    assert sum(got[i] != want[i] for i in got) <= 1
    assert len(set(got.values())) < len(rows) - 60


def test_edge_cases(spark):
    rows = [
        (1, "a b c d e f", 0, "x"), (1, "a b c d e f", 0, "y"), (None, "a b c d e f", 1, "z"), (2, None, 2, None), (3, "", 2, None),
        (1, "another text of one doc id", 3, None), (None, "alone", 4, None)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, t int, bands string")
    got = sorted(((r.doc_id, r.class_id) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (2, 2), (3, 2), (1, 1), (None, None)], key=str)
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, "a b c d e f"), (2, None), (1, "another text of one doc id"), (None, "alone")], key=str
    )
    empty = spark.createDataFrame([], df.schema)
    assert N.near_duplicates(empty).count() == 0 and N.drop_near_duplicates(empty).count() == 0


def test_signatures_estimate_probability_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    shared = rng.integers(1, 2**60, 80).astype(np.uint64)
    docs = [np.concatenate([shared, rng.integers(1, 2**60, 20).astype(np.uint64)]) for _ in range(2)]
    doc = np.repeat([0, 1], 100)
    sig = N.signatures(doc, np.concatenate(docs), np.ones(200), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - 80 / 120) < 0.05
    # scaled weights draw the same signature in distribution, and an element of great weight wins in its share
    w = np.ones(200)
    w[0] = 100
    sig = N.signatures(doc, np.concatenate(docs), w, 2, 2048)
    assert abs((sig[0] == docs[0][0]).mean() - 100 / 199) < 0.05


def test_components(spark):
    from herald.llm._shingles import components

    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60), (60, 50), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, 60: 50}
    assert components(e.filter(F.lit(False))).count() == 0


def test_few_links_are_lost_just_above_the_threshold(spark):
    from collections import Counter

    rows, pairs = [], 0
    for p in range(150):
        turn, base = [f"p{p}t{i}" for i in range(12)], [f"p{p}w{i}" for i in range(220)]
        other = list(base)
        for i in (30, 90, 140, 190)[: 3 + p % 2]:  # each edit changes five of the shingles
            other[i] = f"p{p}x{i}"
        rows += [(2 * p, " ".join(turn * (1 + p % 9) + base)), (2 * p + 1, " ".join(turn * (9 - p % 9) + other))]
        pairs += classes_of(rows[-2:])[2 * p + 1] == 2 * p
    assert pairs == 150
    got = Counter(r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(n == 2 for n in got.values()) >= 0.95 * pairs


def test_large_group_that_no_centre_covers(spark):
    random.seed(9)
    base = text(146).split()
    vary = [f"v{i}" for i in range(6)]
    rows = []
    for i in range(400):  # edits to words that others have too, so that shingles are shared and few pairs are similar
        w = list(base)
        for at in random.sample(range(146), random.randint(1, 9)):
            w[at] = random.choice(vary)
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes_of(rows)
    assert len(set(want.values())) > 3 and sum(got[i] != want[i] for i in got) <= 1


def test_repeated_shingles_do_not_hide_equal_sets(spark):
    rows = []
    for p in range(60):
        turn, rest = [f"p{p}t{i}" for i in range(30)], [f"p{p}r{i}" for i in range(70)]
        # the same hundred shingles, thirty of them once in the first text and twenty times in the second
        rows += [(2 * p, " ".join(turn + turn[:4] + rest)), (2 * p + 1, " ".join(turn * 20 + turn[:4] + rest))]
    assert all(classes_of(rows[2 * p: 2 * p + 2]) == {2 * p: 2 * p, 2 * p + 1: 2 * p} for p in range(60))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(120)}
