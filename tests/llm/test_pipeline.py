"""The whole pipeline against a plain Python version of every stage."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from herald.llm import pieces, quality
from herald.llm._common import tokenizer_file
from tests_llm_helpers import classes_of, fill, without_spread_lines

DIR = "/root/testdata/sf0.001"


def good(rows, labels):
    x = {i: np.array(quality.statistics(t or "")) for i, t, _ in rows}
    own = {c: np.array([x[i] for i, y in labels if y == c and i in x and quality.crc_of(str(i)) % 5]) for c in (0, 1)}
    n = {c: len(v) for c, v in own.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in own.items()}
    both = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    density = {}
    for c in (0, 1):
        s = 0.9 * cov[c] + 0.1 * both
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        mean, inv, det = own[c].mean(axis=0), np.linalg.inv(s), np.linalg.slogdet(s)[1]
        density[c] = {i: np.log(n[c] / (n[0] + n[1])) - 0.5 * det - 0.5 * (v - mean) @ inv @ (v - mean) for i, v in x.items()}
    return [r for r in rows if density[1][r[0]] - density[0][r[0]] >= np.log(0.3 / 0.7)]


def without_lines(rows):
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites[x.strip(" ")].add(s)
    spread = {x for x, s in sites.items() if x and len(s) >= (5 if len(x.split()) >= 3 else 25)}
    texts = [(t, s) for _, t, s in rows]
    return [(i, without_spread_lines(t, spread, texts), s) for i, t, s in rows]


def mixed(rows):
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    target = fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    copies, out = Counter(), []
    for i, t, s in sorted(rows, key=lambda r: hashlib.md5(f"7:{r[0]}".encode()).hexdigest()):
        whole = int(target[s] // sizes[s])
        rest = target[s] - whole * sizes[s]
        out += [(i, t)] * min(2, whole + (rest > 0 and copies[s] + size[i] / 2 <= rest))
        copies[s] += size[i]
    return out


def test_pipeline_equals_plain_python(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "source").collect()
    labels = [tuple(r) for r in spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "quality").collect()]
    rows = without_lines(good([tuple(r) for r in docs], labels))
    root = classes_of([(i, t) for i, t, _ in rows])
    rows = mixed([r for r in rows if root[r[0]] == r[0]])
    p = pieces.Pieces(*pieces.load(tokenizer_file("piece_bpe_32k.model")))
    want = Counter((i, p.encode_bytes(t or "")) for i, t in rows)
    got = Counter((r.doc_id, bytes(r.ids)) for r in cp.run(spark, DIR).collect())
    assert got == want


def _folder(spark, tmp_path, name, docs, labels):
    path = f"file://{tmp_path}/{name}"
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    assert cp.run(spark, _folder(spark, tmp_path, "empty", docs.limit(0), labels)).count() == 0
    rows = [
        (1, "a b c d e f g", None, "x", None), (1, "a b c d e f g", None, "x", None), (None, None, "s", "y", 1), (2, "", "s", None, 2),
        (3, "own words of the third", "u", "z", 3), (4, "w " * 40000, "u", "z", 3)
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, t string, words int").withColumns(
        {"drop": F.lit(1), "bands": F.lit("b"), "size": F.lit(2), "label": F.lit("l")}
    )
    out = cp.run(spark, _folder(spark, tmp_path, "odd", odd, labels.limit(0))).collect()
    assert {r.doc_id for r in out} >= {1, 3, 4} and all(bool(r.ids) == (r.n_pieces > 0) for r in out)
