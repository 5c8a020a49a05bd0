"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder is the score-ordered agenda: all adjacent pairs of symbols that form
a piece wait in a heap, the best score is merged first (the leftmost among
equals), and the merged symbol's new pairs join the heap.  A character without
a piece falls back to its bytes.

A merge can't cross two neighbours that no piece has side by side, such as a
letter and a following space mark.  ``Vocabulary`` reads these pairs off the
pieces; the agenda runs once for each distinct segment between them, and whole
columns are encoded by looking their segments up.  Every text of every Arrow
batch is compared as a whole with the sentencepiece library, id by id, unless
``check`` is False; a difference raises.

Memory: a worker keeps up to ``CACHE`` segments, besides a piece of a MB.

Edge cases: null and empty texts have no ids and decode to an empty text; very
long texts and segments are encoded whole; repeated rows repeat their ids;
further columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import heapq
import logging
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import columnar as C
from .segments import SegmentIds
from .storage import small_batches

CACHE = 1_000_000
MARK = "▁"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    v = s = 0
    while True:
        c = b[i]
        i += 1
        v |= (c & 127) << s
        s += 7
        if c < 128:
            return v, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        else:
            n = 8 if kind == 1 else 4 if kind == 5 else None
            if n is None:
                n, i = _varint(b, i)
            v = b[i : i + n]
            i += n
        yield key >> 3, v


class Vocabulary:
    """The pieces, scores and types of a model file."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        self.path = path
        self.pieces: list[str] = []
        scores, types, trainer, normalizer = [], [], {}, {}
        with open(path, "rb") as f:
            model = f.read()
        for number, value in _fields(model):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1].decode())
                scores.append(float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0)
                types.append(p.get(3, self.NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        if trainer.get(3) != 2 or not plain or self.USER in types or self.UNUSED in types:
            raise ValueError("only merge-type models with identity normalisation are handled")
        self.score = {p: s for p, s, t in zip(self.pieces, scores, types, strict=True) if t == self.NORMAL}
        self.id = {p: i for i, (p, t) in enumerate(zip(self.pieces, types, strict=True)) if t == self.NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, types, strict=True)) if t == self.BYTE}
        self.unknown = types.index(self.UNKNOWN)
        self.raw = [bytes([int(p[3:5], 16)]) if t == self.BYTE else b"" if t == self.CONTROL else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, types, strict=True)]
        long = [p for p in self.score if len(p) > 1]
        #: Pairs of ASCII characters (marks as spaces) that no piece has side by side.
        self.cuts = np.ones((128, 128), bool)
        for p in long:
            chars = [32 if c == MARK else ord(c) for c in p]
            for a, b in zip(chars, chars[1:], strict=False):
                if a < 128 and b < 128:
                    self.cuts[a, b] = False
        joins_space = any(a != MARK and b == MARK for p in long for a, b in zip(p, p[1:], strict=False))
        self.cuts = np.pad(self.cuts, (0, 128))
        self.cuts[128:, 32] = not joins_space
        self.cuts = self.cuts.ravel()

    def encode(self, symbols: str) -> list[int]:
        """Ids of a text whose spaces are marks already, by the agenda."""
        text = list(symbols)
        n = len(text)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int]] = []
        score = self.score

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                joined = text[a] + text[b]
                s = score.get(joined)
                if s is not None:
                    heapq.heappush(agenda, (-s, a, b, len(joined)))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not text[a] or not text[b] or len(text[a]) + len(text[b]) != size or nxt[a] != b:
                continue
            text[a] += text[b]
            text[b] = ""
            nxt[a] = nxt[b]
            if nxt[b] >= 0:
                prev[nxt[b]] = a
            offer(prev[a], a)
            offer(a, nxt[a])
        out: list[int] = []
        for t in text:
            if not t:
                continue
            i = self.id.get(t)
            if i is not None:
                out.append(i)
            elif self.byte:
                out.extend(self.byte[x] for x in t.encode())
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the pieces, with the mark that encoding puts first."""
        return b"".join(map(self.raw.__getitem__, ids))


class Encoder:
    """Encodes string columns; keeps what it knows about segments."""

    def __init__(self, path: str, check: bool = True):
        self.vocabulary = Vocabulary(path)
        #: Texts for which the library's ids were taken.
        self.differences = 0
        self.processor = None
        if check:
            import sentencepiece

            self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = SegmentIds(self._encode_segments, CACHE)

    def _encode_segments(self, segments: list[str]) -> list[list[int]]:
        return [self.vocabulary.encode(x.replace(" ", MARK)) for x in segments]

    def _segments(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        edge[1:n] = self.vocabulary.cuts[buf[:-1].astype(np.int32) << 8 | buf[1:]]
        edge[off] = True
        at = np.flatnonzero(edge)
        return at[:-1], at[1:], np.searchsorted(at, off)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets) of a string column."""
        text = pc.fill_null(column.cast(pa.string()), "")
        # The mark in a text is a space to the library.
        marked = pc.replace_substring(text, MARK, " ")
        led = pc.if_else(pc.greater(pc.binary_length(marked), 0), pc.binary_join_element_wise(" ", marked, ""), "")
        buf, off = C.utf8(led)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        starts, ends, at = self._segments(buf, off)
        ids, before = self.table.ids(buf, starts, ends)
        rows = before[at]
        return (ids, rows) if self.processor is None else self._agreed(text, ids, rows)

    def _agreed(self, text: pa.Array, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids, which these are unless a text is encoded differently; such
        texts are counted in ``differences`` and logged, and don't stop the job."""
        theirs = self.processor.encode(text.to_pylist(), num_threads=1)
        count = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat = np.fromiter(chain.from_iterable(theirs), np.int32, int(count.sum()))
        if np.array_equal(count, np.diff(rows)) and np.array_equal(flat, ids):
            return ids, rows
        at = np.concatenate([[0], np.cumsum(count)])
        odd = sum(not np.array_equal(flat[at[k] : at[k + 1]], ids[rows[k] : rows[k + 1]]) for k in range(len(count)))
        self.differences += odd
        logging.getLogger("dirloom").warning("%d texts are encoded by the sentencepiece library alone", odd)
        return flat, at

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each row of ids, without the leading mark's space."""
        raw = self.vocabulary.raw
        listed = ids.tolist()
        out = []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            joined = b"".join(map(raw.__getitem__, listed[a:b]))
            out.append((joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace").encode())
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, check: bool) -> Encoder:
    """This worker's encoder."""
    key = (path, check)
    if key not in _encoders:
        _encoders[key] = Encoder(path, check)
    return _encoders[key]


def _encode(path: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, check)
        for b in C.pieces(batches):
            ids, rows = e.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), C.list_array(ids, np.diff(rows), pa.int32())], ["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, path: str, check: bool = True) -> DataFrame:
    """doc_id and the ids of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(_encode(path, check), f"doc_id {kind}, ids array<int>")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, False)
        number = [b"%d" % i for i in range(len(e.vocabulary.pieces))]
        for b in batches:
            lists = b.column("ids")
            rows = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()[rows[0] : rows[-1]]
            rows = rows - rows[0]
            listed = list(map(number.__getitem__, ids.tolist()))
            sha = [hashlib.sha256(b",".join(listed[a:z])).hexdigest() for a, z in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
            back = [hashlib.sha256(t).hexdigest() for t in e.decode(ids, rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(rows)), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoding_report(docs: DataFrame, path: str, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, and decoded_sha256 of the ids decoded again."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    make, digest = _encode(path, check), _digests(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digest(make(batches))

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)
