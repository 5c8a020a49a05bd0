"""Sets of distinct word n-grams of string columns, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import columnar as C

_U = np.uint64


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted in each row, row offsets): the distinct n-grams of each text."""
    buf, off = C.utf8(column)
    low = C.LOWER[buf]
    starts, ends, at = C.words(low, off)
    h = C.hash_spans(low, starts, ends)
    grams, first = C.ngrams(h, at, n)
    row = C.rows_of(at)[first]
    count = np.diff(at)
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            acc = h[at[short]].copy()
            for j in range(1, k):
                acc = acc * _U(0xD6E8FEB86659FD93) + h[at[short] + j]
            grams = np.concatenate([grams, C.mix(acc + _U(k))])
            row = np.concatenate([row, short])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(count) + 1))


def signatures(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for k in (0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(h ^ _U(k)), dtype=np.uint64)])
        out.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
    return out[0], out[1]
