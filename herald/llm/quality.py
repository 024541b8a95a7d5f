"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance, shrunk towards the pooled covariance
and then towards its own diagonal. A document's score is the probability of
class 1 from the difference of the two log densities, each a Mahalanobis
distance by the class's Cholesky factor, computed once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herald.llm._common import WORD, materialize, text_of

NAMES = (
    "words", "word length", "distinct", "symbols", "marks", "upper", "repeats", "short", "stops", "lines", "same lines", "top word", "long",
    "digits", "capitals"
)
_SYMBOLS = "#*$%&|<>"
_find = re.compile(WORD).findall


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of ``NAMES``; finite for any text."""
    words = _find(text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    counts, log = Counter(words), np.log
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = list(map(len, words))
    share = lambda k: float(log(k / n + 0.002))
    return [
        float(log(1 + n)), float(log(sum(lengths) / n)), float(log(len(counts)) / log(n + 1)), share(sum(map(text.count, _SYMBOLS))), share(
            text.count("!") + text.count("?")
        ),
        share(
            sum(map(str.isupper, words)) - sum(1 for w in words if len(w) == 1 and w.isupper())
        ), share(sum(map(eq, words, words[1:]))), share(sum(1 for k in lengths if k <= 3)), share(text.count(".")),
        share(len(lines)), share(len(lines) - len(set(lines))), share(max(counts.values())), share(sum(1 for k in lengths if k >= 12)), share(sum(map(str.isdigit, words))), share(sum(1 for w in words if w[0].isupper())),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = pa.array([statistics(t.as_py()) for t in part.column("text")], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), x], names=["doc_id", "x"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")
    ).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants and log priors; index 0 and 1 are the classes."""

    means: np.ndarray
    inverse: np.ndarray
    offset: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverse[c].T
            density.append(self.offset[c] - 0.5 * (z * z).sum(axis=1))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = np.array(batch.column("x").to_pylist(), float).reshape(-1, d)
        label = np.array(batch.column("label").to_pylist())
        for c in (0, 1):
            own = x[label == c]
            total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    k = total.shape[1]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([0, 1], k).astype(np.int32)), pa.array(np.tile(np.arange(k), 2).astype(np.int32)), pa.array(total.ravel())],
        names=["label", "at", "value"]
    )


def fit(rows: DataFrame, pooled: float = 0.1, diagonal: float = 0.05, ridge: float = 1e-3) -> Discriminant:
    """Fit on all ``rows`` (x, label 0 or 1): tasks send sums of counts, values and products only.

    Without a row of either class all scores are the share of class 1, 0.5 without rows.
    """
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for r in rows.mapInArrow(_sums, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        total[r["label"], r["at"]] = r["value"]
    n = total[:, 0]
    if n.min() < 1:
        prior = np.log((n + 1e-9) / (n.sum() + 2e-9))
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), prior)
    means = total[:, 1: 1 + d] / n[:, None]
    cov = [total[c, 1 + d:].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    both = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    inverse, offset = [], []
    for c in (0, 1):
        s = (1 - pooled) * cov[c] + pooled * both
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + ridge * np.eye(d)
        factor = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(factor))
        offset.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(inverse), np.array(offset))


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves no remainder by 5."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0


def scores(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.3, **shrinkage) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, column).

    Only ids and labels that are not null and not held out are learnt from;
    scores see the text alone. Null texts count as empty, and an empty text
    has a score too. Rows with a null doc_id are scored; repeated doc_ids are
    scored by their own texts, and each of their labels counts. Empty tables
    are allowed. Other columns are not read.
    """
    x = materialize(features(docs))
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")
    ).filter(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
    model = fit(x.join(known, "doc_id").select("x", "label"), **shrinkage)
    return apply(x, model, threshold)


def apply(x: DataFrame, model: Discriminant, threshold: float) -> DataFrame:
    """Scores of rows (doc_id, x) of :func:`features`: each row by itself, null doc_ids too; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.array(batch.column("x").to_pylist(), float).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all columns and repeated rows stay.

    The model is the one of :func:`scores`; each text is scored where it lies.
    A null text counts as empty. An empty table stays empty; without labels all
    scores are 0.5, so all documents stay.
    """
    known = labels.select(
        F.col("doc_id").cast("long").alias("__d"), F.col(column).cast("int").alias("label")
    ).filter(~held_out(F.col("__d")) & F.col("label").isin(0, 1))
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        known.select("__d").distinct(), F.col("doc_id") == F.col("__d"), "left_semi"
    )
    model = fit(features(learn).join(known, F.col("doc_id") == F.col("__d")).select("x", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array([statistics(t or "") for t in part.column("text").to_pylist()])
                good = model.score(x) >= threshold if len(x) else np.zeros(0, bool)
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def crc_of(text: str) -> int:
    """The checksum that :func:`held_out` uses, in Python."""
    return zlib.crc32(text.encode())
