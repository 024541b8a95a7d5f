"""URL filter, importance resampling and ranked search against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from herald.llm import lexical, resample, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = "word " * 30_000
TEXTS = [
    None, "", "   ", "One two two Three", "ONE two; two-three ÄÖ ß 12", "one two two three", "é " * 25, "x" * 70_000, LONG, LONG, "the cat sat on the mat",
    "a b " * 40, "\n\t~{}[]", "naïve café naïve café Zürich",
]


def corpus(n, seed=5):
    random.seed(seed)
    pool = [f"w{i}" for i in range(60)] + ["é", "Ab", "aB", "日本", "x1"]
    return [" ".join(random.choices(pool, k=random.choice([0, 3, 19, 20, 21, 60]))) for _ in range(n)]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# --- URL filter ---
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, host string, k long")


def test_rules(spark):
    urls = [
        "http://a.example.com/x", "http://a.example.com/en/x", "HTTP://WWW.Example.COM/en/x?q=/fr/", "http://b.net/es/", "http://b.net/es", "http://b.net",
        "http://notexample.com/en/", "http://example.com", "no scheme/en/", None, "", "x://", "ftp://u@b.net:8/fr/#t", "http://com/", "http://a.b?x://c.net/es/",
        "a://" + "y" * 50_000 + ".com/" + "z" * 50_000,
    ]
    df = pages(spark, [(i, u, "clash", 1) for i, u in enumerate(urls)])
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.judge(df, none).collect()}
    want = ["com/", "example.com/en/", "www.example.com/en/", "net/es/"] + [None] * 2 + ["com/"] + [None] * 6 + ["com/", None, "com/"]
    assert [got[i].rule for i in range(len(urls))] == want
    assert [got[i].verdict for i in range(4)] == ["allow", "block", "allow", "block"]
    assert (got[2].host, got[2].path) == ("www.example.com", "/en/x") and (got[8].host, got[8].path) == ("", "") == (got[9].host, got[9].path)
    assert (got[12].host, got[12].path, got[12].verdict) == ("u@b.net:8", "/fr/", "allow") and got[15].path == "/" + "z" * 50_000
    kept = url_filter.keep_allowed(df, none)
    assert kept.columns == df.columns and {r.page_id for r in kept.collect()} == {i for i in got if got[i].verdict == "allow"}
    assert url_filter.judge(df.limit(0), none).count() == 0


def shrunk_by_hand(counts, z=1.645):
    """Bounds by host, from {host: (n, k)} of two-label domains."""
    def strength(groups):
        s = sum((k - n * p) ** 2 - n * p * (1 - p) for n, k, p in groups)
        pairs = sum(n * (n - 1) * p * (1 - p) for n, k, p in groups)
        return 1 / min(max(s / pairs if pairs else 0, 1e-4), 0.5) - 1

    def level(cut):
        out = defaultdict(lambda: [0, 0])
        for h, (n, k) in counts.items():
            out[cut(h)][0] += n
            out[cut(h)][1] += k
        return out

    n, k = (sum(x[i] for x in counts.values()) for i in (0, 1))
    p = (k + 1) / (n + 5)
    rate, up = {"": (p, p * (1 - p) / (n + 6))}, lambda h: ""
    for parts in (1, 2, 99):
        def cut(h, parts=parts):
            return ".".join(h.split(".")[-parts:])

        groups = {g: (a, b, rate[up(g)][0]) for g, (a, b) in level(cut).items()}
        m, was, rate = strength(groups.values()), rate, {}
        for g, (a, b, p) in groups.items():
            q = (b + m * p) / (a + m)
            rate[g] = q, q * (1 - q) / (a + m + 1) + (m / (a + m)) ** 2 * was[up(g)][1]
        up = cut
    return {h: p - z * math.sqrt(v) for h, (p, v) in rate.items()}


def test_reputation(spark):
    random.seed(8)
    hosts = [f"{a}.{b}.{c}" for a in ("x", "y", "z") for b in ("good", "bad", "new") for c in ("org", "io")]
    rows, outcomes, counts = [], [], {h: [0, 0] for h in hosts}
    for i in range(900):
        h = "x.bad.org" if i % 3 == 0 else random.choice(hosts)  # a third on one host
        rows.append((i, f"https://{h}/p{i}", "clash", i))
        bad = random.random() < (0.9 if ".bad." in h else 0.05)
        if i % 2 and ".new." not in h:
            outcomes.append((i, bad))
            counts[h][0] += 1
            counts[h][1] += bad
    outcomes += [(5000, True), (None, True), (2, None)]
    labels = spark.createDataFrame(outcomes, "page_id long, bad boolean")
    got = url_filter.judge(pages(spark, rows), labels, rules=[]).collect()
    want = shrunk_by_hand(counts)
    assert len(got) == 900
    for r in got:
        assert r.rule is None and abs(r.bound - want[r.host]) < 1e-5 and r.verdict == ("block" if want[r.host] > 0.5 else "allow")
        assert r.n_labelled == counts[r.host][0]
    assert {r.host.split(".")[1] for r in got if r.verdict == "block"} == {"bad"}


def test_registered_domains(spark):
    names = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.z.org", "localhost", "10.0.0.1:80", "u@a.b.org:8080", ""]
    df = spark.createDataFrame([(n,) for n in names], "host string")
    domain, suffix = url_filter.registered_domain(df["host"])
    got = [(r.d, r.s) for r in df.select(domain.alias("d"), suffix.alias("s")).collect()]
    assert got == [
        ("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("z.org", "org"), ("localhost", "localhost"),
        ("10.0.0.1", "10.0.0.1"), ("b.org", "org"), ("", ""),
    ]


# --- importance resampling ---
def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(rows, target, buckets=10_000):
    """{doc_id: (n_features, weight, score)} and the drawn ids in order; ids are distinct."""
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    s, t = Counter(bucket(g) for _, x in rows for g in features(x)), Counter(bucket(g) for x in target for g in features(x))
    s_all, t_all, out = s.total() + buckets, t.total() + buckets, {}
    for i, x in rows:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in map(bucket, features(x)))
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out[i] = (len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((i for i, x in rows if len(words(x)) >= 20), key=lambda i: (-out[i][2], i))
    return out, able[: 5 * len(able) // 100]


def test_resample(spark, monkeypatch):
    texts = TEXTS + corpus(300)
    rows, target = list(enumerate(texts)), [None, "w1 w2 w3 é", "w1 w2 W3 日本"]
    df = spark.createDataFrame([(i, x, "clash", i) for i, x in rows], "doc_id long, text string, rank string, weight long")
    to = spark.createDataFrame([(x,) for x in target], "text string")
    want, drawn = resampled(rows, target)
    got = {r.doc_id: r for r in resample.importance(df.repartition(5), to).collect()}
    assert {i: (r.n_features, r.weight, r.score) for i, r in got.items()} == want
    assert [i for i in sorted(got, key=lambda i: got[i].rank or 1e9) if got[i].rank] == drawn
    assert sorted(r.rank for r in got.values() if r.rank) == list(range(1, len(drawn) + 1))
    kept = resample.resample(df, to)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(drawn)


def test_resample_edges(spark):
    to = spark.createDataFrame([("a b c",)], "text string")
    df = spark.createDataFrame([(None, "w " * 30), (7, "w " * 30), (7, "w " * 30)] + [(i, "u " * 25) for i in range(100, 140)], "doc_id long, text string")
    got = resample.importance(df, to).collect()
    assert len(got) == 43 and sorted(r.rank for r in got if r.rank) == [1, 2]
    assert len({(r.weight, r.score) for r in got if r.doc_id == 7}) == 1
    assert resample.importance(df.limit(0), to).count() == 0
    assert {r.rank for r in resample.importance(df, to.limit(0)).collect()} == {1, 2, None}


def test_table_verifies_bytes(monkeypatch):
    """Keys that all clash still give one place for each distinct n-gram."""
    random.seed(1)
    runs = [random.choice(["aa", "ab", "b" * 8, "b" * 9, "c" * 17 + random.choice("xy"), "d", "e" * 300]).encode() for _ in range(300)]
    ends = np.cumsum([len(r) + 1 for r in runs]) - 1
    starts = ends - [len(r) for r in runs]
    grams = [b" ".join(runs[i : i + n]) for n in (1, 2, 3) for i in range(len(runs) - n + 1)]
    for hashed, rows in ((lambda b: 7, lambda c: np.zeros(len(c[0]), np.uint64)), (lambda b: len(b), lambda c: c[0].astype(np.uint64)), (xxhash.xxh64_intdigest, resample.hash_rows)):
        monkeypatch.setattr(resample.xxhash, "xxh64_intdigest", hashed)
        monkeypatch.setattr(resample, "hash_rows", rows)
        table = resample.GramTable(b" ".join(runs), starts, ends, np.zeros(len(runs), int), np.ones(len(runs), bool), 10_000)
        places = {(g, s) for g, s in zip(grams, table.slots.tolist())}
        assert len(places) == len(set(grams)) == len({s for _, s in places})
        assert {g: int(table.count[s]) for g, s in places} == Counter(grams)
        assert all(table.bucket[s] == zlib.crc32(g) % 10_000 for g, s in places)


def test_hashes_and_crc():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3):
        rows = rng.integers(0, 1 << 40, (50, n))
        want = [xxhash.xxh64_intdigest(r.astype("<i8").tobytes()) for r in rows]
        assert resample.hash_rows(list(rows.T)).tolist() == want
    a, b = [rng.bytes(n) for n in rng.integers(0, 3000, 40)], [rng.bytes(n) for n in rng.integers(0, 3000, 40)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    assert resample.joined_crc(crc(a), crc(b), np.array([len(x) for x in b])).tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_chunks_lose_nothing(monkeypatch):
    texts = TEXTS + corpus(60)
    for size in (1, 50, 1000):
        monkeypatch.setattr(resample, "CHUNK", size)
        found, n_words = Counter(), Counter()
        texts_ = [t for t in texts if size > 1 or len(t or "") < 1000]
        for table, rows, word_rows in resample.tables(texts_, 10_000):
            found.update(zip(rows.tolist(), table.bucket[table.slots].tolist()))
            n_words.update(word_rows.tolist())
        assert found == Counter((i, zlib.crc32(g.encode()) % 10_000) for i, t in enumerate(texts_) for g in features(t))
        assert n_words == Counter({i: len(words(t)) for i, t in enumerate(texts_) if words(t)})


# --- ranked search ---
def searched(rows, items, k=10):
    n = {i: Counter(words(x)) for i, (_, x) in enumerate(rows)}
    n = {i: c for i, c in n.items() if c}
    total, df = sum(c.total() for c in n.values()), Counter(t for c in n.values() for t in c)
    w = {t: math.floor(1000 * math.log((2 * len(n) + 2) / (2 * d + 1))) for t, d in df.items()}
    terms = defaultdict(set)
    for i, x in items:
        terms[i] |= set(words(x))
    out = []
    for item, ts in terms.items():
        found = []
        for i, c in n.items():
            m = 10 + 90 * c.total() * len(n) // total
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, rows[i][0] is None, rows[i][0] or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_ranked_search(spark):
    texts = TEXTS + corpus(300) + ["w1 w2 w3"] * 30
    rows = list(enumerate(texts)) + [(3, "w1 w2"), (3, "w1 w2"), (None, "w9 rare")]
    items = [(1, "w1 w2 W3"), (2, None), (3, "nothing here of it"), (4, "RARE w9"), (5, " ".join(f"w{i}" for i in range(60)) + " é Ab 日本 x1 one two three cat"), (6, "w5"), (6, "w6"), (None, "word é")]
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], "doc_id long, text string, score long, term string")
    to = spark.createDataFrame([(i, x, 0) for i, x in items], "item_id long, text string, doc_id long")
    got = lexical.ranked_search(df.repartition(6), to)
    assert sorted((tuple(r) for r in got.collect()), key=str) == searched(rows, items)
    assert lexical.ranked_search(df.limit(0), to).count() == 0 and lexical.ranked_search(df, to.limit(0)).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", 4)
    monkeypatch.setattr(lexical, "BLOCK", 50)
    rows = list(enumerate(corpus(80, 9)))
    items = [(f"q{i}", x) for i, x in enumerate(corpus(12, 10))]
    got = lexical.ranked_search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == searched(rows, items, 3)


def test_masks_stop_early():
    """Few documents are scored where one term is rare, and what is found is the same."""
    rng = np.random.default_rng(2)
    n, terms, parts, ends = 5000, [], [], [0]
    for i in range(n):
        have = [0] + [1] * (i % 500 == 7) + [2] * (i % 3 == 0)
        terms += have
        parts += [int(x) for x in np.array([10, 5000, 20])[have] + rng.integers(0, 5, len(have))]
        ends.append(len(terms))
    ends = np.array(ends)
    block = lexical.Block(np.arange(n), ends[:-1], ends[1:], np.array(terms), np.array(parts), 3)
    best = lexical._Best(10)
    assert block.search(np.array([0, 1, 2]), best) < 200
    sums = np.add.reduceat(np.array(parts), ends[:-1])
    want = sorted(zip((-sums).tolist(), range(n)))[:10]
    assert [(-s, d) for s, d in zip(best.scores.tolist(), best.docs.tolist())] == want
