"""Vectorised text primitives over Arrow string columns.

A batch of texts is one ``uint8`` buffer with ``int64`` row offsets.  Everything
below works on whole buffers with numpy, so the cost per byte is a few machine
operations; no function loops over words in Python.  Batches are cut into
pieces of a MB (``pieces``) to bound the temporaries; a single longer text
is one piece and is still hashed in blocks.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_BLOCK = 1 << 19
_U = np.uint64

#: Word separators of the contracts: space and U+0009..U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
#: Bytes of a span that have factors of their own.
_SPAN = 1 << 12
_PLACES = np.random.default_rng(20240301).integers(1, 2**63, _SPAN, dtype=np.uint64) | _U(1)
_pow: list[np.ndarray] = []
_PRIME = (1 << 31) - 1
_pow31: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, _BLOCK + 1)
        tables = []
        for base in (_BASE, _BASE_INV):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _pow[:] = tables
    return _pow[0], _pow[1]


def _powers31(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo the prime 2 ** 31 - 1."""
    if not _pow31 or len(_pow31[0]) < n:
        tables = []
        for base in (1_234_567_891, pow(1_234_567_891, -1, _PRIME)):
            t = np.ones(1, np.uint64)
            size = max(n, _BLOCK + 1)
            while len(t) < size:
                more = t[: size - len(t)]
                t = np.concatenate([t, more * _U(pow(base, len(t), _PRIME)) % _U(_PRIME)])
            tables.append(t)
        _pow31[:] = tables
    return _pow31[0], _pow31[1]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads a 64-bit value over all bits."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


#: Bytes of texts after which freed memory goes back to the system.
_TRIM_BYTES = 1 << 25


def trim() -> None:
    """Give memory that numpy and Arrow have freed back: a worker lives on between tasks, and
    its executor's memory is shared with the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def released(run):  # noqa: ANN001, ANN201
    """``run`` (batches to batches), which gives its memory back at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches with at most ``most`` text bytes, or one row."""
    seen = 0
    for batch in batches:
        seen += batch.nbytes
        if seen > _TRIM_BYTES:
            trim()
            seen = 0
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield batch.slice(i, j - i)
            i = j
    trim()


def _runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at row boundaries."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(member[1:], member[:-1], out=edge[1:])
    cut = off[(off > 0) & (off < n)]
    edge[cut] = True
    at = np.flatnonzero(edge)
    stop = np.append(at[1:], n)
    keep = member[at]
    return at[keep], stop[keep]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets into these) of the runs without SPACE bytes."""
    starts, ends = _runs(~SPACE[buf], off)
    return starts, ends, np.searchsorted(starts, off)


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty \\n-split lines, as ``words`` gives words."""
    starts, ends = _runs(buf != 10, off)
    return starts, ends, np.searchsorted(starts, off)


def _hash_short(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        hi = ends[j - 1]
        s, e = starts[i:j] - lo, ends[i:j] - lo
        place = np.arange(hi - lo, dtype=np.int32) - np.repeat(s.astype(np.int32), np.diff(np.append(s, hi - lo)))
        h = np.empty(hi - lo + 1, np.uint64)
        h[0] = 0
        np.cumsum(_BYTES[buf[lo:hi]] * _PLACES[place & (_SPAN - 1)], out=h[1:])
        out[i:j] = mix(h[e] - h[s])
        i = j
    return out


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, disjoint spans of ``buf``.

    Each byte's random value times the random factor of its place is added up; spans
    of over ``_SPAN`` bytes are cut and their parts' hashes mixed with their numbers,
    so no string's inner regularity cancels out, as in a polynomial modulo 2 ** 64."""
    size = ends - starts
    if not len(size) or size.max() <= _SPAN:
        return _hash_short(buf, starts, ends)
    parts = np.maximum(-(-size // _SPAN), 1)
    row, k = ragged(parts)
    s = starts[row] + k * _SPAN
    h = _hash_short(buf, s, np.minimum(s + _SPAN, ends[row]))
    at = np.cumsum(parts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ mix(k.astype(np.uint64) + _U(1))), dtype=np.uint64)])
    return np.where(parts > 1, mix(sums[at] - sums[at - parts] + size.astype(np.uint64)), h[at - parts])


def ngrams(h: np.ndarray, row_off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each n-gram that lies in one row."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        acc *= _U(0xD6E8FEB86659FD93)
        acc += h[k : len(h) - n + 1 + k]
    ok = np.ones(len(acc), bool)
    for k in range(1, n):
        bad = row_off[1:-1] - k
        ok[bad[(bad >= 0) & (bad < len(ok))]] = False
    at = np.flatnonzero(ok)
    return mix(acc[at]), at


def rows_of(row_off: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(row_off) - 1), np.diff(row_off))


def row_sums(values: np.ndarray, row_off: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row."""
    c = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return c[row_off[1:]] - c[row_off[:-1]]


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, position within its row) for rows of these sizes."""
    counts = np.asarray(counts, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - first[row]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
