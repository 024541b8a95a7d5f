"""Quality rules by line labels: a linear-chain conditional random field marks content and boilerplate.

Each line has statistics; the field scores a labelling of all lines of a text
by weights of the statistics for either label and by weights of neighbouring
labels. Viterbi decoding finds the best labelling; the share of words in
content lines decides whether the document is kept, after the plain rules.

Lines have no labels of their own, so the field learns from documents: the
lines of a document of good quality count as content, and those of a bad one
as boilerplate, unless the same line stands in a good document of the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herald.llm._common import WORD, materialize, text_of
from herald.llm.quality import held_out

_SYMBOLS = "#*$%&|<>"
_find = re.compile(WORD).findall
#: Statistics of a line, in order.
NAMES = ("one", "symbols", "marks", "upper", "repeats", "variety", "short", "stops", "same line", "few words")
#: Documents of each class that the field is fitted on, at most, and of their sequences of lines.
SAMPLE = 1500
#: Lines of a sequence; a text of more counts as several.
SEQUENCE = 256


def line_statistics(line: str, words: list[str], seen: bool) -> list[float]:
    n = len(words)
    return [
        1.0, min(1.0, 2.0 * sum(map(line.count, _SYMBOLS)) / n), min(1.0, 2.0 * line.count("!") / n), sum(
            1 for w in words if len(w) > 1 and w.isupper()
        ) / n,
        sum(map(eq, words, words[1:])) / n, len(set(words)) / n, sum(1 for w in words if len(w) <= 3) / n,
        min(1.0, 5.0 * line.count(".") / n), float(seen), 1.0 / n,
    ]


def measures(text: str) -> tuple[dict, list[int], list[int], list[list[float]]]:
    """The plain counts of a text; of its lines that have a word: index, words, statistics."""
    words: list[str] = []
    at, sizes, stats, seen, same = [], [], [], set(), 0
    for i, line in enumerate(text.split("\n")):
        own = _find(line)
        if not own:
            continue
        again = line in seen
        same += again
        seen.add(line)
        words += own
        at.append(i)
        sizes.append(len(own))
        stats.append(line_statistics(line, own, again))
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, _SYMBOLS)),
        "n_dup_lines": same, "n_repeat_words": repeated_words(words),
    }, at, sizes, stats


def repeated_words(words: list[str], k: int = 3) -> int:
    """Words that lie in a window of ``k`` words found twice or more."""
    n = len(words)
    if n <= k:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    key = np.zeros(n - k + 1, np.int64)
    for i in range(k):
        key = key * len(number) + ids[i: n - k + 1 + i]
        if len(number) ** (i + 2) > 1 << 62:  # renumber the partial windows
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    cover = np.zeros(n, bool)
    for i in range(k):
        cover[i: n - k + 1 + i] |= twice
    return int(cover.sum())


@dataclass
class Chain:
    """``weights`` (statistics) score label 1, content, against 0; ``links[i, j]`` scores label i before j."""

    weights: np.ndarray
    links: np.ndarray

    def decode(self, stats: list[list[float]]) -> list[int]:
        """The best labels (Viterbi); on a tie content."""
        if not stats:
            return []
        gain = (np.array(stats) @ self.weights).tolist()
        (a00, a01), (a10, a11) = self.links.tolist()
        s0, s1, back = 0.0, gain[0], []
        for g in gain[1:]:
            to0, to1 = (s0 + a00, 0) if s0 + a00 > s1 + a10 else (s1 + a10, 1), (s0 + a01, 0) if s0 + a01 > s1 + a11 else (s1 + a11, 1)
            s0, s1 = to0[0], to1[0] + g
            back.append((to0[1], to1[1]))
        label = 0 if s0 > s1 else 1
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def fit_chain(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = 150, penalty: float = 1e-5) -> Chain:
    """Maximum conditional likelihood by Adam, of statistics and labels of the lines of each sequence.

    Sequences are padded to the longest, at most ``SEQUENCE`` as
    :func:`learn` makes them, and run through forward and backward sums
    together.
    """
    d = len(NAMES)
    w, links = np.zeros(d), np.zeros((2, 2))
    if not sequences:
        w[0] = 1.0
        return Chain(w, links)
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    lengths = np.array([len(sequences[i]) for i in order])
    longest, total = int(lengths[0]), int(lengths.sum())
    x, y = np.zeros((longest, len(order), d)), np.zeros((longest, len(order)), np.int64)
    for j, i in enumerate(order):
        x[: lengths[j], j], y[: lengths[j], j] = sequences[i], labels[i]
    here = [int((lengths > t).sum()) for t in range(longest)]
    value = np.concatenate([w, links.ravel()])
    m1, m2 = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, steps + 1):
        w, links = value[:d], value[d:].reshape(2, 2)
        score = np.stack([np.zeros(x.shape[:2]), x @ w], axis=2)
        fore = np.zeros_like(score)
        fore[0] = score[0]
        for t in range(1, longest):
            b = here[t]
            fore[t, :b] = np.logaddexp(fore[t - 1, :b, :1] + links[0], fore[t - 1, :b, 1:] + links[1]) + score[t, :b]
        back = np.zeros_like(score)
        gw, gl = np.zeros(d), np.zeros((2, 2))
        for t in range(longest - 1, -1, -1):
            b = here[t]
            c = here[t + 1] if t + 1 < longest else 0
            if c:
                after = score[t + 1, :c] + back[t + 1, :c]
                back[t, :c] = np.logaddexp(links[:, 0] + after[:, :1], links[:, 1] + after[:, 1:])
                joint = fore[t, :c, :, None] + links + after[:, None, :]
                joint -= np.logaddexp.reduce(joint.reshape(c, 4), axis=1)[:, None, None]
                p = np.exp(joint)
                gl -= p.sum(axis=0)
                gl += np.bincount(2 * y[t, :c] + y[t + 1, :c], minlength=4).reshape(2, 2)
            q = fore[t, :b] + back[t, :b]
            p1 = np.exp(q[:, 1] - np.logaddexp(q[:, 0], q[:, 1]))
            gw += (y[t, :b] - p1) @ x[t, :b]
        g = np.concatenate([gw, gl.ravel()]) / total - penalty * value
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        value = value + 0.3 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Chain(value[:d], value[d:].reshape(2, 2))


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Chain:
    """Fit on at most ``sample`` documents of each class, those of least md5 of their id; held-out ids are not learnt from.

    A text of more than ``SEQUENCE`` lines makes several sequences, and of the
    sequences of each class again ``sample`` are used, those of least md5, so
    that what comes to the driver is bounded. Null ids, labels other than 0
    and 1, and labels without a document are left out; without any, all lines
    are content. Repeated ids are learnt from with each of their texts.
    """
    known = labels.select(
        F.col("doc_id").cast("long").alias("d"), F.col(column).cast("int").alias("label")
    ).filter(F.col("d").isNotNull() & ~held_out(F.col("d")) & F.col("label").isin(0, 1)).dropDuplicates(["d"])
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    order = F.md5(F.col("d").cast("string"))
    there = known.join(ids, F.col("d") == F.col("doc_id"), "left_semi")
    chosen = there.filter("label = 0").orderBy(order, "d").limit(sample).unionByName(
        there.filter("label = 1").orderBy(order, "d").limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                _, at, _, stats = measures(text)
                lines = text.split("\n")
                names = np.array([xxhash.xxh3_64_intdigest(lines[i]) for i in at], np.uint64)
                x = np.array(stats, np.float32)
                for i in range(0, len(at), SEQUENCE):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([label], pa.int32()), pa.array([x[i: i + SEQUENCE].tobytes()], pa.binary()),
                            pa.array([names[i: i + SEQUENCE].tobytes()], pa.binary())
                        ],
                        names=["label", "x", "names"]
                    )

    # at most 2 * sample ids; what comes back is as many sequences of bounded length
    few = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")
    ).join(F.broadcast(chosen), F.col("doc_id") == F.col("d"))
    sequences = materialize(few.select("text", "label").mapInArrow(run, "label int, x binary, names binary"))
    order = [F.md5("x"), F.md5("names")]
    rows = [r for y in (0, 1) for r in sequences.filter(F.col("label") == y).orderBy(*order).limit(sample).collect()]
    rows = [
        (
            np.frombuffer(r["x"], np.float32).reshape(-1, len(NAMES)).astype(float), r["label"], np.frombuffer(r["names"], np.uint64)
        ) for r in rows if r["x"]
    ]
    good = np.unique(np.concatenate([n for _, y, n in rows if y] or [np.zeros(0, np.uint64)]))
    return fit_chain([x for x, _, _ in rows], [np.full(len(n), 1) if y else np.isin(n, good).astype(np.int64) for _, y, n in rows])


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, content_share double, boilerplate array<int>"


def assess(docs: DataFrame, chain: Chain) -> DataFrame:
    """Each row of ``docs`` (doc_id, text): the plain counts, the share of words in content lines, and the indices of boilerplate lines.

    Lines are ``\\n``-separated and count if they have a word; a text without
    words, also a null one, has share 0. Rows with a null or repeated doc_id
    are assessed one by one. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(start, 1024), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    counts, at, sizes, stats = measures(text)
                    labels = chain.decode(stats)
                    content = sum(n for n, y in zip(sizes, labels) if y)
                    rows.append(
                        {
                            "doc_id": doc_id, **counts, "n_lines": len(at), "content_share": content / max(1, counts["n_words"]),
                            "boilerplate": [i for i, y in zip(at, labels) if not y]
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")],
        ("content_share", pa.float64()), ("boilerplate", pa.list_(pa.int32()))
    ]
)


def verdicts(docs: DataFrame, labels: DataFrame, least_share: float = 0.5) -> DataFrame:
    """:func:`assess` with ``base_failed`` (under 50 words, or over half of them in repeated windows) and ``kept``.

    Nulls, repeated rows and extra columns are treated as there and in
    :func:`learn`; an empty table gives an empty result.
    """
    found = assess(docs, learn(docs, labels))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumns({"base_failed": failed, "kept": ~failed & (F.col("content_share") >= least_share)})
