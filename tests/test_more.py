"""Identity, head-based changes, files, grounding bounds, scores: against plain Python."""

import json
import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from herald.functions import text as X
from herald.operators import annotations as G
from herald.operators import claims as C
from herald.operators import evaluate as J
from herald.operators import monitoring as M
from herald.operators import obligations as O
from herald.operators import retrieval as R
from herald.operators import versions as N
from herald.sources import files

T0 = datetime(2026, 1, 1)


def folded(rows):
    """Outcomes by a fold over observations: compared with the head, which keeps its title where only badges went."""
    own, head, out = {}, {}, []
    strip = lambda t: " ".join(w for i, w in enumerate(t.split()) if not all(x in ("Hot", "New") for x in t.split()[i:]))
    for key, url, title, day, body in rows:
        own.setdefault(key, url)
        if url != own[key]:
            out.append("DUPLICATE")
        elif key not in head:
            out.append("CREATED")
            head[key] = (title, day, body)
        elif (title, day, body) == head[key] or (strip(head[key][0]) == title and (day, body) == head[key][1:]):
            out.append("UNCHANGED")
        else:
            out.append("UPDATED")
            head[key] = (title, day, body)
    return out, head


def test_changes_are_those_of_a_fold(spark):
    random.seed(11)
    rows = [
        (
            f"n{random.randint(0, 5)}", random.choice(["a", "a", "a", "b"]), random.choice(["X", "X", "X Hot", "X Hot New", "Y"]),
            random.choice(["d", "d", "e"]), random.choice(["t", "t", "t", "u"])
        ) for _ in range(400)
    ]
    want, head = folded(rows)
    df = spark.createDataFrame(
        [(i, T0 + timedelta(minutes=i), *r) for i, r in enumerate(rows)],
        "i int, observed_at timestamp, notice_key string, normalized_url string, title string, publication_date string, raw_text string"
    )
    df = df.withColumn(
        "content_hash",
        N.content_hash(F.col("title"), F.col("publication_date"), F.col("raw_text"), F.expr("cast(array() as array<string>)"))
    )
    got = N.classify_changes(df)
    assert [r.outcome for r in got.orderBy("i").collect()] == want and set(want) == {"CREATED", "UPDATED", "UNCHANGED", "DUPLICATE"}
    assert {r.notice_key: (r.title, r.publication_date) for r in N.heads(got).collect()} == {k: v[:2] for k, v in head.items()}


def test_identity_by_url_then_id(spark):
    urls = [
        ("https://mirror.example/1", "dut:1"),  # before the notice itself: its own notice
        ("https://notices.example/id/1", None), ("https://notices.example//id/1/?ref=x", None),  # the notice, by two forms of its URL
        ("https://other.example/one", "dut:1"), ("https://mirror.example/1", "dut:1"), ("https://notices.example/b/id/1", None), ("https://other.example/none", None), ("https://other.example/two", "dut:9")]
    df = spark.createDataFrame(
        [(i, T0 + timedelta(minutes=i), u, c) for i, (u, c) in enumerate(urls)],
        "i int, observed_at timestamp, canonical_url string, claimed string"
    )
    got = {r.i: r.notice_key for r in N.resolve_identity(df, "notices.example", namespace="dut", shared=F.col("claimed")).collect()}
    one = "https://notices.example/id/1"
    assert got == {
        0: "https://mirror.example/1", 1: one, 2: one, 3: one, 4: "https://mirror.example/1", 5: one, 6: "https://other.example/none",
        7: "https://other.example/two"
    }


def test_files(spark, tmp_path):
    for name, body in {
        "a.json": {"notice_id": 1, "version_id": 1, "notes": "first"}, "b.json": {"notice_id": 1, "version_id": 1, "notes": "last"},
        "c.json": {"notice_id": 2, "version_id": 1}
    }.items():
        (tmp_path / name).write_text(json.dumps(body, indent=1))
    (tmp_path / "d.json").write_text('{"notice_id": 3, ')
    got = {(r.notice_id, r.version_id): r.notes for r in files.read_annotations(spark, f"file://{tmp_path}/*.json").collect()}
    assert got == {(1, 1): "last", (2, 1): None}
    inventory = {r.path.rsplit("/", 1)[1]: (r.bytes, len(r.sha256)) for r in files.inventory(spark, f"file://{tmp_path}").collect()}
    assert inventory["d.json"] == (17, 64) and len(inventory) == 4

    df = spark.createDataFrame([(1, "é", None), (2, None, [1.5])], "a int, b string, c array<double>")
    manifest = files.write_jsonl(df, f"file://{tmp_path}/out").first()
    (tmp_path / "out" / "part-9.json").write_text("no json\n")
    back = files.read_jsonl(spark, f"file://{tmp_path}/out", "a int, b string, c array<double>")
    assert manifest.rows == 2 and files.fingerprint(back.repartition(3)).first().digest == manifest.digest
    assert files.fingerprint(df.withColumn("b", F.lit("x"))).first().digest != manifest.digest


def test_grounding_is_the_best_ratio(spark):
    random.seed(13)
    word = lambda: "".join(random.choice("abcd") for _ in range(random.randint(1, 6)))
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(8)) for _ in range(6)]
        quote = list(random.choice(lines))
        for _ in range(random.randint(1, 5)):
            quote[random.randrange(len(quote))] = random.choice("abcd ")
        rows.append((i, "".join(quote), "\n".join(lines)))
    got = {r.quote_id: r.grounded for r in O.ground(spark.createDataFrame(rows, "quote_id long, quote string, raw_text string")).collect()}
    for i, quote, text in rows:
        q = " ".join(quote.split())
        if quote in text:
            assert got[i] == quote
            continue
        best = max(
            text.split("\n"),
            key=lambda s: max(min(len(q), len(s)) / max(len(q), len(s)) if q in s or s in q else 0, SequenceMatcher(None, q, s).ratio())
        )
        score = max(
            min(len(q), len(best)) / max(len(q), len(best)) if q in best or best in q else 0, SequenceMatcher(None, q, best).ratio()
        )
        assert got[i] == (best if score >= 0.88 or q == best else None)


def test_pieces_keep_offsets_of_any_character(spark):
    texts = ["a\u0001.b\u0002.😀c", ".", "", "x" * 3 + ".y" * 700]
    rows = spark.createDataFrame(
        [(i, t) for i, t in enumerate(texts)], "i int, t string"
    ).select("i", X.pieces("t", r"\.").alias("p")).collect()
    for r in rows:
        assert [p.text for p in r.p] == texts[r.i].split(".") and all(texts[r.i][p.start:p.start + len(p.text)] == p.text for p in r.p)


def test_long_message_is_cut_once(spark):
    text = " ".join(f"Câu số {i} nộp đơn." for i in range(900))
    rows = C.segment_claims(spark.createDataFrame([(1, text)], "message_id int, text string")).collect()
    assert len(rows) == 900 and all(text[r.start_char:r.end_char] == r.text and r.claim_ix == i for i, r in enumerate(rows))


def test_composed_text(spark):
    c = C.with_normalized(
        C.segment_claims(spark.createDataFrame([(1, "Nộp  đơn"), (2, "nộp"), (3, None)], "message_id int, text string"))
    )
    assert {r.message_id: r.normalized_text for r in c.collect()} == {1: "Nộp đơn", 2: "nộp"}


def test_contained_passages_of_any_length(spark):
    p = spark.createDataFrame([(1, "one two"), (2, "A b  c d e f"), (3, ""), (4, None), (5, "x")], "item_id int, text string")
    d = spark.createDataFrame(
        [(1, "zero ONE two three"), (2, "a b c d e f"), (3, "one x two"), (4, None), (5, "a b c d e g a b c d e")],
        "doc_id int, text string"
    )
    assert {(r.item_id, r.doc_id) for r in J.contained(p, d).collect()} == {(1, 1), (2, 2), (5, 3)}


@pytest.mark.parametrize("n", [1, 2, 7, 50_000])
def test_order_statistics(spark, n):
    import numpy as np

    random.seed(n)
    v = [random.choice([random.random(), 0.5]) for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in [*v, None]], "v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        assert abs(J.order_statistics(df, "v", share, True).first().value - np.quantile(v, share)) < 1e-12
    assert J.percentile_at(df, "v", 0.95).first().value == sorted(v)[min(n - 1, int(0.95 * n))]
    assert J.order_statistics(df.filter("v is null"), "v", 0.5, True).first().value is None


def test_lexical_phrases_inside_words(spark):
    n = spark.createDataFrame(
        [(1, "evergreen tree", "c", ""), (2, "tree", "c", "the evergreen trees"), (3, "other", "green", "")],
        "notice_id int, title string, category string, text string"
    )
    q = spark.createDataFrame([(1, "green"), (2, "Green tree"), (3, "nothing")], "query_id int, text string")
    got = {(r.query_id, r.notice_id): (r.score, r.reasons) for r in R.lexical_rank(n, q, least=15).collect()}
    assert got[1, 1] == (100, ["title phrase"])
    assert got[2, 1][0] == 120 and got[1, 2][0] == 30 and got[1, 3][0] == 15 and got[2, 2][0] == 50 and not any(k[0] == 3 for k in got)


def test_dense_lists(spark):
    v = spark.createDataFrame(
        [(i, [float(i % 3), 1.0]) for i in range(10)] + [(99, None)], "vec_id long, embedding array<double>"
    ).repartition(3)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "query_id long, vector array<double>")
    full = R.dense_search(v, q, None, block=1).orderBy("query_id", "rank").collect()
    assert [
        r.vec_id for r in full if r.query_id == 1
    ] == sorted(range(10), key=lambda i: (-(i % 3), i)) and [r.vec_id for r in full if r.query_id == 3] == list(range(10))
    assert [r.vec_id for r in R.dense_search(v, q, 2).filter("query_id = 1").orderBy("rank").collect()] == [2, 5]


def test_curation_and_catalog(spark):
    flat = spark.createDataFrame(
        [("1", "Tin học", "CNTT"), ("2", "Toán", "cntt"), ("2", "Toán", None)], "official_code string, program string, alias string"
    )
    names = spark.createDataFrame([("cntt",), (" TOÁN ",), ("Lý",)], "name string")
    assert {r.name: r.official_code for r in G.resolve_alias(names, flat).collect()} == {"cntt": "1", " TOÁN ": "2", "Lý": None}
    stored = spark.createDataFrame([(1, "1_0"), (2, "2_0")], "notice_id int, chunk_id string")
    v = spark.createDataFrame([(1, 1, "a"), (2, 2, "b\n\nc")], "notice_id int, version_id int, raw_text string")
    e = spark.createDataFrame([(2, "UPDATED"), (1, "UNCHANGED")], "notice_id int, outcome string")
    assert sorted(r.chunk_id for r in M.rebuild_changed(stored, v, e, R.chunk_versions).collect()) == ["1_0", "2_0", "2_1"]
