"""Ids of distinct segments, kept by a worker in flat arrays."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from . import columnar as C

_U = np.uint64
_LEAST = 1 << 14
#: Longer segments are hashed by ``columnar.hash_spans``.
_SHORT = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, disjoint segments, eight bytes a step."""
    size = ends - starts
    words = np.ndarray(len(buf) + 1, "<u8", np.append(buf, np.zeros(8, np.uint8)), strides=(1,))
    h = C.mix(size.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    h = C.mix(h ^ words[starts] & _FIRST[np.minimum(size, 8)])
    more, k = np.flatnonzero((size > 8) & (size <= _SHORT)), 8
    while len(more):
        h[more] = C.mix(h[more] ^ words[starts[more] + k] & _FIRST[np.minimum(size[more] - k, 8)])
        k += 8
        more = more[size[more] > k]
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        h[long] = C.hash_spans(buf, starts[long], ends[long])
    return h


class SegmentIds:
    """Looks segments up by their 64-bit hash; new ones go to ``encode``, a batch at a time.

    The hashes lie side by side; an open table of at least twice as many places as there
    are hashes has their numbers.  Ids are kept in 16 bits while all fit.  At most ``most``
    segments are kept (some 40 bytes each); beyond that all are forgotten and met anew.
    ``encode`` gets strings read by ``codec``."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int, codec: str = "utf-8"):
        self.encode, self.most, self.codec = encode, most, codec
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin = np.zeros(1, np.int32)  # and the end of the last
        self.flat = np.zeros(0, np.uint16)
        self._make(_LEAST)

    def _make(self, places: int) -> None:
        self.mask = _U(places - 1)
        self.entry = np.full(places, -1, np.int32)  # -1: free
        self._put(0)

    def _put(self, first: int) -> None:
        """The hashes from this one on, distinct and not in the table."""
        entry = np.arange(first, len(self.hashes), dtype=np.int32)
        at = (self.hashes[first:] & self.mask).astype(np.int64)
        while len(at):
            free = np.flatnonzero(self.entry[at] < 0)
            self.entry[at[free]] = entry[free]  # of several for one place the last stays
            left = self.entry[at] != entry
            entry, at = entry[left], (at[left] + 1) & int(self.mask)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int32)
        at = (h & self.mask).astype(np.int64)
        out = self.entry[at]
        todo = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        at = at[todo]
        while len(todo):
            at = (at + 1) & int(self.mask)
            out[todo] = here = self.entry[at]
            go_on = (here >= 0) & (self.hashes[here] != h[todo])
            todo, at = todo[go_on], at[go_on]
        return out

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        """Distinct hashes, none of them known."""
        lists = self.encode(texts)
        count = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(count.sum()))
        narrow = self.flat.dtype == np.uint16 and flat.max(initial=0) < 1 << 16
        known = len(self.hashes)
        self.hashes = np.concatenate([self.hashes, h])
        self.begin = np.concatenate([self.begin, (len(self.flat) + np.cumsum(count)).astype(np.int32)])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint16) if narrow else flat], dtype=np.uint16 if narrow else np.int32)
        if 2 * len(self.hashes) > len(self.entry):
            self._make(1 << int(4 * len(self.hashes)).bit_length() - 1)
        else:
            self._put(known)

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments one behind the other, ids before each segment and in all)."""
        h = np.maximum(_hashes(buf, starts, ends), _U(1))
        if len(self.hashes) > self.most:
            self._forget()
        i = self._find(h)
        fresh = np.flatnonzero(i < 0)
        if len(fresh):
            unique, first = np.unique(h[fresh], return_index=True)
            raw = buf.tobytes()
            new = fresh[first]
            self._learn(unique, [raw[s:e].decode(self.codec) for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            i[fresh] = self._find(h[fresh])
        begin = self.begin[i]
        count = self.begin[1:][i] - begin
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(count, dtype=np.int64)])
        at = np.repeat(begin - before[:-1], count)
        at += np.arange(len(at))
        return self.flat[at].astype(np.int32), before
