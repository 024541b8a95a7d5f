"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of the pieces.

The pieces of a ``sentencepiece`` vocabulary file, but for control and byte
pieces, are the keys of a double-array trie over UTF-8 bytes. The encoding of
a text is the segmentation of greatest summed log score; of equal sums, the
one whose last piece starts first, and so on backwards. A character that no
piece covers costs ``min - 10`` and is written as its bytes.

White space is marked: a text gets a leading space, and each space becomes
``MARK``. No piece holds a ``MARK`` after another character, nor a newline, so
a text falls apart before runs of marks and around newlines; each part's ids
are found once and remembered up to a bound.

A vocabulary made by byte-pair merging has ranks in place of log scores: 0 for
the first merge, -1 for the next and so on, and none for characters. Such
ranks r become Zipf's log scores ``-ln(r + 2)``, characters the least of them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herald.llm._common import text_of

MARK = "▁"
#: Bytes of parts of texts and their ids that each Python worker remembers, with what Python adds to each.
CACHE, ENTRY = 64 << 20, 250
#: A part of more characters is not remembered.
LONG = 100
PENALTY = 10.0


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays base, check, value: from state s the byte c leads to ``base[s] + c`` if ``check`` of that is s; value is a key's index or -1.

    State 0 is the root. Keys are placed in order of their prefixes, each
    state's children in the next free place that holds them all; stretches that
    are nearly full are not searched again.
    """
    children: list[dict[int, int]] = [{}]
    final: dict[int, int] = {}
    for i, key in enumerate(keys):
        node = 0
        for c in key:
            node = children[node].setdefault(c, len(children)) if c in children[node] else _grow(children, node, c)
        final[node] = i
    size = len(children) * 2 + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = bytearray(size)
    used[0] = 1
    place, todo, first = {0: 0}, [0], 0
    for node in todo:
        kids = children[node]
        s = place[node]
        value[s] = final.get(node, -1)
        if not kids:
            continue
        codes = sorted(kids)
        at, seen = first, 0
        while True:
            at += 1
            b = at - codes[0]
            if at + 256 >= size:
                grow = size
                base, check, value = (np.concatenate([a, np.full(grow, f, np.int32)]) for a, f in ((base, 0), (check, -1), (value, -1)))
                used += bytearray(grow)
                size += grow
            if used[at]:
                seen += 1
            elif b > 0 and not any(used[b + c] for c in codes):
                break
        if seen >= 0.9 * (at - first):  # what lies before is nearly full
            first = at
        base[s] = b
        for c in codes:
            used[b + c] = 1
            check[b + c] = s
            place[kids[c]] = b + c
            todo.append(kids[c])
    last = int(np.flatnonzero(np.frombuffer(bytes(used), np.uint8))[-1]) + 257
    return base[:last].copy(), check[:last].copy(), value[:last].copy()


def _grow(children: list[dict[int, int]], node: int, c: int) -> int:
    children.append({})
    children[node][c] = len(children) - 1
    return len(children) - 1


class Pieces:
    """A vocabulary with its trie; encodes and decodes single texts."""

    def __init__(
        self, pieces: list[str], scores: list[float], byte_ids: list[int], base: np.ndarray, check: np.ndarray, value: np.ndarray,
        piece_ids: list[int]
    ):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.base, self.check = base.tolist(), check.tolist()
        ids = [piece_ids[v] if v >= 0 else -1 for v in value.tolist()]
        self.id_at, self.score_at = ids, [scores[i] if i >= 0 else 0.0 for i in ids]
        self.unknown = min((scores[i] for i in piece_ids), default=0.0) - PENALTY
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.key = hashlib.sha1("\0".join(pieces).encode() + np.array(scores, "<f8").tobytes()).hexdigest()

    def part(self, text: str) -> list[int]:
        """Viterbi over one part of a marked text."""
        data = text.encode("utf-8", "replace")
        n = len(data)
        best, back, piece = [-1e300] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, ids, scores, limit = self.base, self.check, self.id_at, self.score_at, len(self.check)
        i = 0
        while i < n:
            lead = data[i]
            step = i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, state, j = best[i], 0, i
            single = False
            while j < n:
                t = base[state] + data[j]
                if t >= limit or check[t] != state or not t:
                    break
                state = t
                j += 1
                k = ids[t]
                if k >= 0:
                    s = here + scores[t]
                    if s > best[j]:
                        best[j], back[j], piece[j] = s, i, k
                    single = single or j == step
            if not single and here + self.unknown > best[step]:
                best[step], back[step], piece[step] = here + self.unknown, i, -1
            i = step
        out = []
        while n:
            i = back[n]
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out.extend(self.byte_ids[b] for b in reversed(data[i:n]))
            n = i
        return out[::-1]

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        known, parts = self.known, _parts(MARK + text.replace(" ", MARK))
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if self.held > CACHE:
                known.clear()
                self.held = 0
            out = []
            for p in parts:
                ids = known.get(p)
                if ids is None:
                    ids = np.array(self.part(p), "<u4").tobytes()
                    if len(p) <= LONG:
                        known[p] = ids
                        self.held += ENTRY + len(p) + len(ids)
                out.append(ids)
            return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of byte pieces are joined, marks become spaces, the leading one goes."""
        out = bytearray()
        byte_of, pieces = self.byte_of, self.pieces
        for i in ids:
            b = byte_of.get(i)
            if b is None:
                out += pieces[i].encode()
            else:
                out.append(b)
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


#: Each newline alone; else a run of marks with what follows it.
_parts = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+").findall


@lru_cache(maxsize=2)
def load(path: str) -> tuple:
    """What :class:`Pieces` is made of, from a vocabulary file, read on the driver; sent to tasks as it is."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, raw = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
    byte_ids = [i for i in range(n) if sp.is_byte(i)]
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    if any(MARK in pieces[i].lstrip(MARK) or "\n" in pieces[i] for i in plain):
        raise ValueError("a piece holds a newline, or a mark that is not at its start")
    if len(byte_ids) != 256:
        raise ValueError("the vocabulary has no byte pieces")
    ranked = any(s < -1e6 for s in raw) or [raw[i] for i in plain[:3]] == [0.0, -1.0, -2.0]
    scores = raw
    if ranked:
        least = -float(np.log(2.0 + max((-raw[i] for i in plain if raw[i] > -1e6), default=0.0)))
        scores = [max(least, -float(np.log(2.0 - s))) if s <= 0 else 0.0 for s in raw]
    return pieces, scores, byte_ids, *double_array([pieces[i].encode() for i in plain]), plain


_made: dict = {}


def _pieces(sent) -> Pieces:
    if sent.id not in _made:
        _made.clear()
        _made[sent.id] = Pieces(*sent.value)
    return _made[sent.id]


class _Sent:
    """A broadcast with a name that workers remember it by."""

    def __init__(self, broadcast, id_: str):
        self.broadcast, self.id = broadcast, id_

    @property
    def value(self):
        return self.broadcast.value


_sent: dict[tuple[str, str], _Sent] = {}


def _send(docs: DataFrame, path: str) -> _Sent:
    """The vocabulary, sent once for an application and file."""
    context = docs.sparkSession.sparkContext
    key = (context.applicationId, path)
    if key not in _sent:
        parts = load(path)
        _sent[key] = _Sent(context.broadcast(parts), hashlib.sha1(repr((path, parts[0][-50:], parts[1][-50:])).encode()).hexdigest())
    return _sent[key]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary, n_pieces, n_bytes) of each row of ``docs`` (doc_id, text).

    ``ids`` are little-endian unsigned 32-bit integers, ``n_bytes`` counts byte
    pieces. A null or empty text has no ids. Characters that UTF-8 cannot hold
    count as ``?``. Rows with a null or repeated doc_id are encoded one by one;
    other columns are not read. The vocabulary's size bounds what is broadcast.
    """
    sent = _send(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(sent)
        low, high = min(p.byte_ids), max(p.byte_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [p.encode_bytes(t) for t in part.column("text").to_pylist()]
                arrays = [np.frombuffer(i, "<u4") for i in ids]
                by = [int(((a >= low) & (a <= high)).sum()) for a in arrays]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(a) for a in arrays], pa.int64()),
                        pa.array(by, pa.int64())
                    ],
                    names=["doc_id", "ids", "n_pieces", "n_bytes"]
                )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")
    ).mapInArrow(run, "doc_id long, ids binary, n_pieces long, n_bytes long")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids).

    Null or empty ids give an empty text. Null and repeated doc_ids, empty
    tables and other columns are treated as by :func:`encode`.
    """
    sent = _send(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(sent)
        for batch in batches:
            texts = [p.decode(np.frombuffer(i or b"", "<u4").tolist()) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_chars, n_pieces, n_bytes, ids_crc32, same): the digest of each row's ids, and whether decoding gives the text back.

    Nulls, empty and very long texts, repeated rows, empty tables and other
    columns are treated as by :func:`encode`.
    """
    sent = _send(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(sent)
        low, high = min(p.byte_ids), max(p.byte_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    data = p.encode_bytes(text)
                    a = np.frombuffer(data, "<u4")
                    rows.append(
                        (doc_id, len(text), len(a), int(((a >= low) & (a <= high)).sum()), zlib.crc32(data), p.decode(a.tolist()) == text)
                    )
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                    names=["doc_id", "n_chars", "n_pieces", "n_bytes", "ids_crc32", "same"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(
        run, "doc_id long, n_chars long, n_pieces long, n_bytes long, ids_crc32 long, same boolean"
    )
