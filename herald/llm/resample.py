"""Target-distribution importance resampling over hashed n-grams.

Features of a text are its runs of one to three words; a feature's bucket is
its CRC-32 modulo the number of buckets. The gain of a bucket is the scaled
logarithm of how much likelier the target texts make it than the documents do.
A document's weight is the sum of the gains of its features, and the documents
with the greatest sums of weight and Gumbel noise are a sample without
replacement by importance.

Texts are read twice, to count and to weigh. Each time a batch's n-grams are
interned in open-addressed NumPy tables: keys are xxhash64, places are found by
linear probing of all keys at once, and contents are compared before two
occurrences share a place. A place stores its bucket and its count, so CRC-32
is worked out once for each distinct n-gram of a chunk, from those of its words.
Chunks hold about ``CHUNK``
bytes of text whatever the texts' lengths; a longer text is cut between words,
with the words that its n-grams reach beyond the cut.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herald.llm._common import materialize
from herald.llm._scan import prefix_sums

#: Bytes of words that are interned together.
CHUNK = 1 << 18
#: Longest run of words that is a feature.
RUN = 3
#: A-Z to lower case, nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: What stands between words, after lower-casing: ASCII other than digits and letters.
_BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: The primes of xxhash64, and the reversed polynomial of CRC-32.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_POLYNOMIAL = 0xEDB88320
_SPACE = zlib.crc32(b" ")


def plain_words(text: str) -> bytes:
    """The words of a text, joined by one space each."""
    return _BETWEEN.sub(b" ", text.encode("utf-8", "surrogatepass").translate(LOWER)).strip(b" ")


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hash_rows(columns: list[np.ndarray]) -> np.ndarray:
    """xxhash64 of rows of at most three 64-bit numbers, as little-endian bytes."""
    h = np.full(len(columns[0]), _P5 + np.uint64(8 * len(columns)), np.uint64)
    for c in columns:
        h ^= _turned(c.astype(np.uint64) * _P2, 31) * _P1
        h = _turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _moves() -> list[np.ndarray]:
    """For each i, what each of a CRC's four bytes becomes when 2**i zero bytes follow."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLYNOMIAL), one >> 1).astype(np.uint32)
    out = [np.stack([one, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(3))])]
    while len(out) < 40:
        last = out[-1]
        out.append(np.stack([_moved(last, row) for row in last]))
    return out


def _moved(move: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return move[0][crc & 255] ^ move[1][crc >> 8 & 255] ^ move[2][crc >> 16 & 255] ^ move[3][crc >> 24]


_MOVES = _moves()


def joined_crc(first: np.ndarray, then: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings, one after the other, from theirs and the second one's length."""
    crc = first.copy()
    for i in range(int(length.max(initial=0)).bit_length()):
        some = np.flatnonzero(length >> i & 1)
        crc[some] = _moved(_MOVES[i], crc[some])
    return crc ^ then


class OpenTable:
    """An open-addressed table: the place of each occurrence, and an occurrence (or -1) at each place."""

    def __init__(self, keys: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        n = len(keys)
        size = 1 << max(4, (2 * n).bit_length())
        at, open_ = (keys & np.uint64(size - 1)).astype(np.int64), np.arange(n)
        self.slots, self.owner = np.empty(n, np.int64), np.full(size, -1, np.int64)
        while len(open_):
            here = at[open_]
            free = self.owner[here] < 0
            self.owner[here[free]] = open_[free]  # of several, one stays
            other = self.owner[here]
            same = keys[other] == keys[open_]
            same[same] = equal(open_[same], other[same])
            self.slots[open_[same]] = here[same]
            open_ = open_[~same]
            at[open_] = (at[open_] + 1) & (size - 1)
        self.used = np.flatnonzero(self.owner >= 0)


class GramTable:
    """The distinct n-grams of a chunk: ``slots`` of the occurrences, ``bucket`` and ``count`` of the slots.

    ``data`` has words at ``starts`` to ``ends``; ``piece`` tells which belong
    together, ``counted`` at which n-grams begin that count. Words are keyed
    by the hash of their bytes and compared byte by byte. A longer n-gram is
    the row of its words' places, keyed by the hash of that row's bytes and
    compared number by number, which is to compare its words' bytes. ``words``
    tells at which word each occurrence begins.
    """

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray, piece: np.ndarray, counted: np.ndarray, buckets: int):
        # the eight bytes from each place on, as one number
        padded = np.frombuffer(data + bytes(8), np.uint8)
        eight = padded[: len(data)].astype(np.uint64)
        for i in range(1, 8):
            eight |= padded[i : len(data) + i].astype(np.uint64) << np.uint64(8 * i)
        length = ends - starts

        def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            same = length[a] == length[b]
            same[same] = _equal(eight, starts[a[same]], starts[b[same]], length[a[same]])
            return same

        spans, hashed = list(zip(starts.tolist(), ends.tolist())), xxhash.xxh64_intdigest
        word = OpenTable(np.fromiter((hashed(data[i:j]) for i, j in spans), np.uint64, len(spans)), equal)
        first, size = word.owner[word.used], len(word.owner)
        alone, wide = np.zeros(size, np.uint32), np.zeros(size, np.int64)
        alone[word.used] = np.fromiter((zlib.crc32(data[i:j]) for i, j in (spans[k] for k in first.tolist())), np.uint32, len(first))
        wide[word.used] = length[first]
        after = joined_crc(np.full(size, _SPACE, np.uint32), alone, wide)  # of a space and the word
        wide += 1
        slots, crcs, begins = [word.slots[counted]], [alone], [np.flatnonzero(counted)]
        for n in range(2, RUN + 1):
            k = len(starts) - n + 1
            if k <= 0:
                break
            begin = np.flatnonzero(counted[:k] & (piece[:k] == piece[n - 1 :]))
            columns = [word.slots[begin + j] for j in range(n)]
            table = OpenTable(hash_rows(columns), lambda a, b, c=columns: np.logical_and.reduce([x[a] == x[b] for x in c]))
            first = table.owner[table.used]
            crc = alone[columns[0][first]]
            for c in columns[1:]:
                crc = joined_crc(crc, after[c[first]], wide[c[first]])
            all_ = np.zeros(len(table.owner), np.uint32)
            all_[table.used] = crc
            slots.append(table.slots + sum(map(len, crcs)))
            crcs.append(all_)
            begins.append(begin)
        self.slots, self.words = np.concatenate(slots), np.concatenate(begins)
        self.bucket = (np.concatenate(crcs) % buckets).astype(np.int64)
        self.count = np.bincount(self.slots, minlength=len(self.bucket))

    def bucket_counts(self, buckets: int) -> np.ndarray:
        """Occurrences of each bucket."""
        return np.bincount(self.bucket, weights=self.count, minlength=buckets).astype(np.int64)


def _equal(eight: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` on and those from ``b`` on are the same."""
    equal, open_, done = np.ones(len(a), bool), np.flatnonzero(a != b), 0
    while len(open_):
        mask = _FIRST[np.minimum(length[open_] - done, 8)]
        ok = ((eight[a[open_] + done] ^ eight[b[open_] + done]) & mask) == 0
        equal[open_[~ok]] = False
        done += 8
        open_ = open_[ok & (length[open_] > done)]
    return equal


def _pieces(texts: Iterable[str | None]) -> Iterator[tuple[int, bytes, int]]:
    """(row, words, own): parts of each text's words, of which the n-grams that begin in the first ``own`` bytes count."""
    for row, text in enumerate(texts):
        data = plain_words(text) if text else b""
        at = 0
        while at < len(data):
            cut = data.find(b" ", at + CHUNK)
            if cut < 0:
                yield row, data[at:] if at else data, len(data) - at
                break
            end = cut
            for _ in range(RUN - 1):
                end = data.find(b" ", end + 1)
                if end < 0:
                    end = len(data)
                    break
            yield row, data[at:end], cut - at
            at = cut + 1


def _chunks(texts: Iterable[str | None]) -> Iterator[list[tuple[int, bytes, int]]]:
    chunk, size = [], 0
    for piece in _pieces(texts):
        if chunk and size + len(piece[1]) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(piece)
        size += len(piece[1])
    if chunk:
        yield chunk


def tables(texts: Iterable[str | None], buckets: int) -> Iterator[tuple[GramTable, np.ndarray, np.ndarray]]:
    """For each chunk of the texts its table, the row of each occurrence, and the rows of its words."""
    for chunk in _chunks(texts):
        data = b" ".join(p[1] for p in chunk)
        sizes = np.array([len(p[1]) for p in chunk], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        own = begin + np.array([p[2] for p in chunk], np.int64)
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
        piece = np.searchsorted(begin, starts, "right") - 1
        counted = starts < own[piece]
        rows = np.array([p[0] for p in chunk], np.int64)[piece]
        table = GramTable(data, starts, ends, piece, counted, buckets)
        yield table, rows[table.words], rows[counted]


def bucket_counts(docs: DataFrame, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket that has any.

    A task sends a row for each bucket at most. Null texts have no features;
    an empty table gives no row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for table, _, _ in tables((x.as_py() for x in batch.column(0)), buckets):
                total += table.bucket_counts(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, text: str = "text") -> np.ndarray:
    """Gain of each bucket, smoothed by one occurrence of each: an array of ``buckets`` integers, whatever the input's size."""

    def counted(df: DataFrame) -> list[int]:
        found = {r["bucket"]: r["n"] for r in bucket_counts(df, buckets, text).collect()}
        return [found.get(b, 0) for b in range(buckets)]

    s, t = counted(docs), counted(target)
    of_docs, of_target = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * of_docs / ((a + 1.0) * of_target))) for a, b in zip(s, t)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of ``docs``; a null text has none of them."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for table, row, word_row in tables((x.as_py() for x in batch.column(1)), buckets):
                words += np.bincount(word_row, minlength=batch.num_rows)
                features += np.bincount(row, minlength=batch.num_rows)
                # sums of whole numbers below 2**53 are exact
                weight += np.bincount(row, weights=gains[table.bucket][table.slots], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long")


def importance(
    docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: int = 42
) -> DataFrame:
    """One row (doc_id, n_words, n_features, weight, score, rank) for each row of ``docs``.

    ``score`` is the weight with Gumbel noise, a function of seed and doc_id.
    Of the rows of at least ``min_words`` words the ``percent`` of greatest
    score get a rank from 1, equal scores by smaller doc_id, null ids last;
    others have a null rank. Null and empty texts have weight 0. Rows that
    repeat an id are drawn each. Without target texts all gains come from the
    documents alone. Empty tables give an empty result. Texts of any length
    take the memory of a chunk besides their own. Other columns are not read.
    """
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = weights(docs, bucket_gains(docs, target, buckets)).withColumn("score", F.col("weight") + noise)
    rows = materialize(rows.withColumn("able", (F.col("n_words") >= min_words).cast("long")))
    many = rows.agg(F.sum("able")).first()[0] or 0
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = prefix_sums(rows, [], order, {"able": "before"})
    rank = F.when((F.col("able") == 1) & (F.col("before") < percent * many // 100), F.col("before") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`importance` draws, all columns as they were.

    ``options`` are those of :func:`importance`. Rows of one id go together,
    and a null id is never drawn.
    """
    drawn = importance(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, docs["doc_id"] == F.col("__drawn"), "left_semi")


#: Counts every n-gram of every text; CRC-32 by its table of 256 remainders, byte by byte.
SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS tab FROM range(256) r(i)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
runs AS (
  SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3),
f AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, runs),
q AS (SELECT unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM b, runs),
fg AS (SELECT doc_id, g, count(*) AS c FROM f GROUP BY 1, 2),
g AS (
  SELECT g, list_prepend(4294967295, list_transform(range(1, strlen(g) + 1), lambda i:
    16 * (strpos('0123456789ABCDEF', hex(g)[2 * i - 1]) - 1) + strpos('0123456789ABCDEF', hex(g)[2 * i]) - 1)) AS bytes
  FROM (SELECT g FROM fg UNION SELECT g FROM q)),
k AS (
  SELECT g, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM g, crc),
s AS (SELECT bucket, sum(c) AS s FROM fg JOIN k USING (g) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM q JOIN k USING (g) GROUP BY 1),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT coalesce(sum(s), 0) + 10000 FROM s) / ((coalesce(s, 0) + 1)::DOUBLE * (SELECT coalesce(sum(t), 0) + 10000 FROM t))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(c) AS n_features, sum(c * gain) AS weight FROM fg JOIN k USING (g) JOIN gain USING (bucket) GROUP BY 1),
r AS (
  SELECT doc_id, len(d.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END::BIGINT AS rank
FROM r LEFT JOIN o USING (doc_id)
"""
