import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests_llm_helpers import fill, without_spread_lines

from herald.llm import chat, fingerprint, license_scan, line_dedup, line_quality, mixing, quality

DOCS = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id long, text string, source string, lang string"):
    return spark.createDataFrame(rows, schema)


# --- chat ---
def test_snapshots_collapse(spark):
    random.seed(3)
    convs = {}
    for c in range(40):
        if convs and random.random() < 0.6:
            base = random.choice(list(convs.values()))
            cut = random.randint(1, len(base))
            convs[c] = base[:cut] + [("user", f"t{random.randint(0, 2)}") for _ in range(random.randint(0, 2))]
        else:
            convs[c] = [(random.choice(["user", "assistant"]), f"t{random.randint(0, 3)}") for _ in range(random.randint(1, 5))]
    rows = [(c, i, r, t, "clash") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")
    keep = {c for c, t in convs.items() if not any((len(o) > len(t) and o[:len(t)] == t) or (o == t and d < c) for d, o in convs.items())}
    out = chat.format_chats(df)
    assert {r.conv_id for r in out.collect()} == keep
    for r in chat.rendered_conversations(out).collect():
        assert r.text == "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in convs[r.conv_id])


def test_chat_edges(spark):
    df = spark.createDataFrame(
        [(1, 0, None, None), (1, 0, None, None), (None, 0, "user", "x"), (2, None, "user", "y"), (2, 1, "user", "z")],
        "conv_id long, turn long, role string, text string"
    )
    got = {(r.conv_id, r.position): r.n_turns for r in chat.format_chats(df).collect()}
    assert got == {(1, 1): 2, (1, 2): 2, (None, 1): 1, (2, 1): 2, (2, 2): 2}
    assert chat.format_chats(df.limit(0)).count() == 0


# --- mixing ---
def test_mix_meets_targets(spark):
    random.seed(4)
    rows = [
        (
            i, " ".join(["w"] * random.randint(0, 40)) if i % 17 else None,
            random.choice(["a", "b", "B", "c", None, "hot", "hot", "hot", "hot"]), "x"
        ) for i in range(400)
    ]
    df = frame(spark, rows)
    out = mixing.mix(df).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).collect()}
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(
            r.target - want[r.source]
        ) < 1e-6 and 0 <= r.taken <= 2 * r.size and again[r.doc_id] == r.taken
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    copies = mixing.take(df)
    assert copies.columns == df.columns
    assert Counter(r.doc_id for r in copies.collect()) == Counter({r.doc_id: r.copies for r in out if r.copies})


def test_mix_edges(spark):
    df = frame(spark, [(1, None, None, None), (None, "a b", "s", None), (None, "a b", "s", None), (2, "c", "s", None)])
    out = mixing.mix(df)
    assert out.count() == 4 and out.filter("source is null").first().taken == 0
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.take(df.limit(0)).count() == 0
    assert mixing.mix(frame(spark, [(1, "", "s", None)])).first().target == 0


def test_take_of_equal_rows_keeps_the_budget(spark):
    rows = [(1, "a b c d", "s", None)] * 5 + [(2, "e f", "s", "x"), (3, "g h i", None, None)] + [(4, "w " * 50, "u", None)] * 9
    df = frame(spark, rows, "doc_id long, text string, source string, size string")
    planned = Counter()
    for r in mixing.mix(df, share=0.7).collect():
        planned[r.doc_id] += r.copies
    taken = mixing.take(df, share=0.7)
    assert taken.columns == df.columns and Counter(r.doc_id for r in taken.collect()) == planned and 0 < planned[4] < 9


# --- fingerprints ---
def test_neighbours(spark):
    random.seed(6)
    rows = [
        (
            i * 2, " ".join(random.choice(["the", "of", "and", f"w{random.randint(0, 500)}"]) for _ in range(random.randint(0, 200))), 0
        ) for i in range(80)
    ] + [(161, None, 0), (163, "é😀x" * 9, 0), (165, "word " * 20000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = {r.doc_id: r for r in fingerprint.neighbour_likeness(df.repartition(5)).collect()}
    texts = [t or "" for _, t, _ in rows]
    assert len(got) == len(rows)
    better = 0
    for n, (i, _, _) in enumerate(rows):
        r, t, nxt = got[i], texts[n], texts[(n + 1) % len(rows)]
        changed = fingerprint.edit(t, nxt)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(
            changed.encode()
        ).hexdigest() and r.fingerprint == fingerprint.simhash(t).hex()
        assert 0 <= r.near_next <= 1 and r.edited_fingerprint == fingerprint.simhash(changed).hex()
        better += r.near_edited > r.near_next
    assert better > 0.9 * len(rows)
    one = fingerprint.neighbour_likeness(df.filter("doc_id = 0")).first()
    assert one.near_next == 1.0
    assert fingerprint.neighbour_likeness(df.limit(0)).count() == 0
    same = fingerprint.neighbour_likeness(spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string"))
    assert same.count() == 3


def test_radius_search_finds_all(spark):
    random.seed(7)
    base = [random.getrandbits(128) for _ in range(60)]
    prints = base + [b ^ sum(1 << k for k in random.sample(range(128), random.randint(1, 7))) for b in base for _ in range(2)]
    hot = random.getrandbits(128)  # many that share blocks: some are near, most are not
    prints += [hot ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 12))) for _ in range(300)]
    rows = [(i, f"{p:032x}") for i, p in enumerate(prints)] + [(999, f"{prints[0]:032x}"), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    hexes = sorted({f"{p:032x}" for p in prints})
    far = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for n, a in enumerate(hexes) for b in hexes[n + 1:]}
    for radius in (3, 4):
        got = {(r.a, r.b): r.distance for r in fingerprint.within_radius(df, radius, hot=20).collect()}
        assert got == {p: d for p, d in far.items() if d <= radius} and got
    count = Counter(x for p, d in far.items() if d <= 3 for x in p)
    assert all(r.n_close == (None if r.fingerprint is None else count[r.fingerprint]) for r in fingerprint.with_neighbours(df).collect())
    assert fingerprint.with_neighbours(df.limit(0)).count() == 0


def plain_simhash(text):
    """The votes one by one."""
    import xxhash

    wide = (1 << 64) - 1

    def scramble(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & wide
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & wide
        return x ^ (x >> 31)

    words = text.split()
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    terms = [(x, 0.5) for x in h] + [(scramble((a * 3 + scramble(b)) & wide), 1.0) for a, b in zip(h, h[1:])]
    if len(words) < 64:
        run = f" {' '.join(words)} "
        terms += [(xxhash.xxh3_64_intdigest(run[i: i + 4]), 1 - len(words) / 64) for i in range(max(1, len(run) - 3))]
    votes = [0.0] * 128
    for term, weight in terms:
        data = b"".join(scramble((term + n * 0x9E3779B97F4A7C15) & wide).to_bytes(8, "little") for n in (1, 2))
        for i in range(128):
            votes[i] += weight if data[i // 8] >> (7 - i % 8) & 1 else -weight
    return votes


def test_simhash_equals_counted_votes():
    random.seed(16)
    for _ in range(40):
        text = " ".join(random.choice(["a", "bc", "déf", f"w{random.randint(0, 60)}"]) for _ in range(random.randint(1, 120)))
        votes, made = plain_simhash(text), fingerprint.simhash(text)
        for i, v in enumerate(votes):
            assert abs(v) < 1e-4 or (made[i // 8] >> (7 - i % 8) & 1) == (v > 0)
    assert fingerprint.simhash(" \n") == bytes(16)


# --- line dedup ---
def test_line_dedup_equals_counting(spark):
    random.seed(8)
    common, rare = [f"boiler plate line number {i}" for i in range(6)], [f"some own line {i} here" for i in range(300)]
    rows = []
    for i in range(200):
        lines = [random.choice(rare) for _ in range(6)] + ([random.choice(common)] if random.random() < 0.7 else []) + ["", "ok"]
        random.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{random.randint(0, 6)}" if i % 13 else None, 1))
    rows += [(900, None, "s1", 1), (901, "", "s1", 1), (902, "\n".join(common), "s2", 1), (902, "\n".join(common), "s2", 1)]
    rows += [
        (903, "\n".join([common[5], "own words of this page", common[0], common[3]]), "s3", 1),
        (904, "\n".join([*common[:5], "edited line of a copy"]), "s4", 1)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, drop int")
    sites = defaultdict(set)
    for _, t, s, _ in rows:
        for x in (t or "").split("\n"):
            if x.strip(" ") and len(x.split()) >= 3 and s:
                sites[x.strip(" ")].add(s)
    spread = {x for x, s in sites.items() if len(s) >= 4}
    want = Counter()
    for i, t, s, d in rows:
        want[i, without_spread_lines(t, spread, [r[1:3] for r in rows], 4), s, d] += 1
    out = line_dedup.dedup_lines(df, sites=4)
    assert out.columns == df.columns and spread
    got = Counter(tuple(r) for r in out.collect())
    assert got - want == want - got == Counter()
    assert next(t for i, t, _, _ in want if i == 903) == "own words of this page"  # mostly boilerplate, but no copy
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0 and line_dedup.report(df.limit(0)).count() == 0


def test_templates_lose_their_menu(spark):
    """Pages of one template on 12 sites lose the menu; copies on five sites, edited or not, stay for near dedup."""
    menu = ["Home page of the site", "Read all our news here", "Contact us for more help", "Terms of use and privacy"]
    own = ["The {0} cat met dog number {0} today", "On day {0} it rained for {0} hours in town {0}", "Recipe {0}: take {0} eggs and stir {0} times"]
    rows = [(i, "\n".join([*menu, own[i % 3].format(f"n{i}")]), f"s{i}", "x") for i in range(12)]
    essay = [f"line {j} of one essay that was copied word {j} for word {j}" for j in range(12)]
    rows += [(100 + i, "\n".join(essay), f"s{i}", "x") for i in range(5)]
    edited = [[*essay[:i], essay[i].replace("copied", f"taken{i}"), *essay[i + 1 : 9], essay[9].replace("word", f"w{i}"), *essay[10:]] for i in range(5)]
    rows += [(200 + i, "\n".join(e), f"s{i + 5}", "x") for i, e in enumerate(edited)]
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert [left[i] for i in range(12)] == [own[i % 3].format(f"n{i}") for i in range(12)]
    assert all(left[i] == t for i, t, _, _ in rows[12:])
    assert sum(r.n_dropped for r in line_dedup.report(frame(spark, rows)).collect()) == 48


def test_line_dedup_edges(spark):
    rows = [(None, "a b c\nx", f"s{i}", i, 0, 0, 0) for i in range(6)] + [
        (7, f"a b c\n{'y ' * 30000}", "s1", 1, 1, 1, 1), (8, None, None, None, None, None, None), (8, None, None, None, None, None, None)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, t1 int, t2 int, k1 int, found int")
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {(None, "a b c\nx"), (7, "y " * 30000), (8, None)}  # six rows are copies of each other
    assert line_dedup.report(df).count() == 9
    short = [(i, f"Home\nown words of page {i}", f"s{i}") for i in range(30)]
    out = line_dedup.dedup_lines(spark.createDataFrame(short, "doc_id long, text string, source string"))
    assert all(r.text == f"own words of page {r.doc_id}" for r in out.collect())


# --- quality ---
def test_base_counts():
    m, *_ = line_quality.measures("a b c x\na b c x\n\na b c\x0by #%  ")
    assert m == {"n_words": 14, "word_chars": 15, "n_symbols": 2, "n_dup_lines": 1, "n_repeat_words": 11}  # a no-break space is a word
    assert line_quality.repeated_words(
        "a b c d a b c".split()
    ) == 6 and line_quality.repeated_words(["x"] * 5) == 5 and line_quality.repeated_words([]) == 0


def brute_repeats(w):
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    return len({j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_repeats_equal_brute_force():
    random.seed(9)
    for _ in range(200):
        w = [random.choice("abcd") for _ in range(random.randint(0, 30))]
        assert line_quality.repeated_words(w) == brute_repeats(w)


def test_viterbi_is_the_best_labelling():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(30):
        n = rng.integers(1, 7)
        stats = rng.normal(size=(n, len(line_quality.NAMES)))
        chain = line_quality.Chain(rng.normal(size=len(line_quality.NAMES)), rng.normal(size=(2, 2)))
        value = lambda y: sum((stats[i] @ chain.weights) * y[i] for i in range(n)) + sum(chain.links[y[i], y[i + 1]] for i in range(n - 1))
        assert value(chain.decode(stats.tolist())) >= max(map(value, product((0, 1), repeat=int(n)))) - 1e-9


def test_fit_is_the_most_likely_chain():
    from itertools import product

    rng = np.random.default_rng(5)
    d = len(line_quality.NAMES)
    true = line_quality.Chain(np.array([-0.5, 2, -1, 1, 0, 0, 0.5, 0, -2, 1]), np.array([[1.0, -1.0], [-0.5, 0.5]]))
    xs = [np.hstack([np.ones((n, 1)), rng.random((n, d - 1))]) for n in rng.integers(1, 6, 60)]
    every = {n: list(product((0, 1), repeat=n)) for n in range(1, 6)}

    def scores(x, w, links):
        return np.array([sum((x[i] @ w) * y[i] for i in range(len(x))) + sum(links[a, b] for a, b in zip(y, y[1:])) for y in every[len(x)]])

    ys = []
    for x in xs:
        p = np.exp(scores(x, true.weights, true.links))
        ys.append(np.array(every[len(x)][rng.choice(len(p), p=p / p.sum())]))
    total = sum(map(len, xs))

    def goal(value):
        w, links = value[:d], value[d:].reshape(2, 2)
        out = -0.5 * 1e-2 * value @ value
        for x, y in zip(xs, ys):
            s = scores(x, w, links)
            out += (s[every[len(x)].index(tuple(y))] - np.logaddexp.reduce(s)) / total
        return out

    chain = line_quality.fit_chain(xs, ys, steps=800, penalty=1e-2)
    at = np.concatenate([chain.weights, chain.links.ravel()])
    slope = [(goal(at + e) - goal(at - e)) / 2e-4 for e in np.eye(d + 4) * 1e-4]
    assert max(map(abs, slope)) < 2e-3 and goal(at) > goal(np.zeros(d + 4))


def test_query_equals_plain_python(spark):
    """op4 against its definition: counts, base rule, best labels by a plain recursion over the learnt weights."""
    import re

    from herald.llm import queries

    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    chain = line_quality.learn(docs, spark.read.parquet(f"{DOCS}/labels.parquet"))
    links = chain.links
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.QUERIES["op4_line_quality"](spark, DOCS).collect()
    assert len(got) == len(text) and {r.kept for r in got} == {True, False}
    for r in got:
        t = text[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, again, seen = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], [], set()
        for x in lines:
            again.append(x in seen)
            seen.add(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", "".join(w))), sum(again), brute_repeats(w)
        )
        assert r.base_failed == (len(w) < 50 or 100 * brute_repeats(w) > 50 * len(w))
        words = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in lines]
        stats = [np.array(line_quality.line_statistics(x, own, s)) for x, own, s in zip(lines, words, again)]
        best = [(0.0, (0,)), (float(stats[0] @ chain.weights), (1,))] if lines else []
        for x in stats[1:]:
            best = [max((best[a][0] + links[a, b] + b * float(x @ chain.weights), best[a][1] + (b,)) for a in (0, 1)) for b in (0, 1)]
        labels = max(best)[1] if lines else ()
        content = sum(len(own) for own, y in zip(words, labels) if y)
        assert r.kept == (not r.base_failed and content >= 0.5 * len(w)) or abs(best[0][0] - best[1][0]) < 1e-9


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_quality_on_held_out_documents(spark, sf):
    d = f"/root/testdata/{sf}"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.scores(docs, labels).collect() if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (quality.crc_of(str(r.doc_id)) % 5 == 0) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)
    kept = line_quality.verdicts(docs, labels).collect()
    bad = [r for r in kept if truth.get(r.doc_id) == 0 and r.kept]
    lost = [r for r in kept if truth.get(r.doc_id) == 1 and not r.kept and not r.base_failed]
    assert len(bad) <= 3 and len(lost) <= 3


def test_quality_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, 1.0), (None, "", 2.0), (2, "x " * 9000, 3.0), (2, "x", 4.0)], "doc_id long, text string, score double"
    )
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.scores(docs, none).collect()] == [0.5] * 4
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality.scores(docs, labels)
    assert out.count() == 4 and all(0 <= r.score <= 1 for r in out.collect())
    assert quality.keep_good(docs, labels).columns == docs.columns and quality.scores(docs.limit(0), labels).count() == 0
    v = line_quality.verdicts(docs, none)
    assert v.count() == 4 and not any(r.kept for r in v.filter("n_words = 0").collect())
    assert line_quality.verdicts(docs.limit(0), labels).count() == 0


# --- licences ---
def test_inheritance(spark):
    rows = [
        ("a", "repo/LICENSE", "Released under the MIT License."), ("b", "repo/src/main.c", "int main"), (
            "c", "repo/src/lib/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."
        ),
        ("d", "repo/src/lib/x/y.c", None), (
            "e", "repo/own.c", "code\nLicensed under the Apache License, Version 2.0.\nmore"
        ), ("f", "other/z.c", "license to kill"), ("g", None, "Licensed under CC BY-NC 4.0."), ("h", "top", ""), ("h", "top", ""),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file_id string, path string, text string, units int")
    got = {r.file_id: (r.own_licence, r.licence, r.via, r.from_dir) for r in license_scan.scan(df).collect()}
    assert got["a"] == ("MIT", "MIT", "own", None) and got["b"] == (None, "MIT", "inherited", "repo")
    assert got["c"][:3] == ("GPL-3.0", "GPL-3.0", "own") and got["d"] == (None, "GPL-3.0", "inherited", "repo/src/lib")
    assert got["e"][:3] == (
        "Apache-2.0", "Apache-2.0", "own"
    ) and got["f"] == (None, None, None, None) and got["g"][1] == "CC-BY-NC-4.0" and got["h"][1] is None
    assert license_scan.scan(df).count() == len(rows) and license_scan.scan(df.limit(0)).count() == 0


def test_documents_lie_at_several_depths(spark):
    mit, plain = "Released under the MIT License.\nx", "no words of that kind"
    ids = {
        3: mit, 4: plain, 1004: plain, 2005: plain, 2009: "This work is licensed under the GNU General Public License, version 3.\ny",
        2012: plain
    }
    df = spark.createDataFrame(
        [(i, t, "s", "en") for i, t in ids.items()] + [(None, None, None, None)], "doc_id long, text string, source string, lang string"
    )
    files = license_scan.documents_as_files(df)
    got = {
        r.file_id: (r.path, r.licence, r.from_dir) for r in license_scan.scan(
            files, licence_file=license_scan.opens_with_licence()
        ).collect()
    }
    assert got[4] == ("s/en/0/4", "MIT", "s/en") and got[1004] == (
        "s/en/1/10/1004", "MIT", "s/en"
    ) and got[2005] == ("s/en/2/2005", "MIT", "s/en")
    assert got[2009][1:] == ("GPL-3.0", None) and got[2012] == (
        "s/en/2/20/2012", "GPL-3.0", "s/en/2/20"
    ) and got[None] == ("-/-/-", None, None)


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    n = docs.count()
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, DOCS)
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
            assert 0.5 * n < out.count() <= (2 * n if i == 3 else n)
            docs = out
    assert out.count() == docs.count() and "ids" in out.columns


def test_wrapped_headers_and_full_texts(spark):
    full = dict(license_scan.full_texts())
    gnu = [
        "This program is free software: you can redistribute it and/or modify",
        "it under the terms of the GNU General Public License as published by",
        "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."
    ]
    bsd = full["BSD-3-Clause"].split("\n")[:2]
    gnu += [
        "This program is distributed in the hope that it will be useful,", "but WITHOUT ANY WARRANTY; without even the implied warranty of",
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the", "GNU General Public License for more details."
    ]
    files = {
        "a/b/head.c": ("import x\n" + "\n".join(f" * {x}" for x in gnu) + "\nint main", "GPL-3.0"), "a/bsd.c": ("start\n" + "\n".join(bsd) + "\nend", "BSD-3-Clause"), "a/spdx.c": ("// SPDX-License-Identifier: MIT\nint main", "MIT"),
        "m/x": ("MIT License", "MIT"), "n/x": ("Licensed under the MIT license", "MIT"), "o/x": (
            "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GPL-3.0"
        ), "p/x": ("the cat sat under the tree with the dog", None),
        "q/LICENSE": ("Copyright (c) 2020 A B\n\n" + full["MIT"], "MIT"), "r/s/COPYING": (full["GPL-2.0"], "GPL-2.0"), "r/s/t/u/v.c": ("int", "GPL-2.0")}
    df = spark.createDataFrame([(p, p, t) for p, (t, _) in files.items()], "file_id string, path string, text string")
    assert {r.file_id: r.licence for r in license_scan.scan(df).collect()} == {p: w for p, (_, w) in files.items()}
