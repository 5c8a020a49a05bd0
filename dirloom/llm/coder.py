"""Adaptive context-mixing range coder for token ids, many streams in step.

Ids are cut into blocks that are coded independently: each begins with an empty
model and has its own checksum.  Within a block the ids are dealt, in order, to
equal streams; all advance together, one id a step, as vectors in numpy, and
share one model, which learns from all of them after each step.

The model mixes three predictions of an id:

* order 2: the id that last followed the two ids before (a hashed table, with a
  confidence for each entry);
* order 1: the id that last followed the id before, likewise;
* order 0: the counts of all ids of the block so far, and of those never seen.

How much of the range orders 2 and 1 get is learned for each pair of their
confidences; order 0 gets the rest, in proportion to its counts.  An id that
none predicts is coded as new, and follows as 16 plain bits.  Each id is one step
of a range coder (48-bit low, 16-bit words, carry into words already out).

Encoder and decoder run the same integer model, so decoding is exact.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

_U = np.uint64
_MAGIC = b"DLID\x02"
_NONE = 0xFFFF  # no id; as a symbol of order 0: a new id
_SLOTS = 18  # bits of the table index of order 2
_TOTAL = 24  # bits of the whole range of a step
_FULL = 1 << 13  # hits and misses of a pair of confidences that are remembered
BLOCK_IDS, LANES, STEPS = 1 << 20, 4096, 128


#: A place's confidences in orders 2 and 1 and whether they were right, as one number.
_PLACE = np.arange(256)
_RIGHT2, _RIGHT1 = _PLACE >> 1 & 1, _PLACE & 1


def _learning(conf: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is added to an entry, and all bits where the id met replaces it."""
    return np.where(right, conf < 7, (conf >> 1) - conf).astype(np.int32), np.where(right | (conf > 1), 0, -1).astype(np.int32)


_LEARN2 = _learning(_PLACE >> 5, _RIGHT2)
_LEARN1 = _learning(_PLACE >> 2 & 7, _RIGHT1)


class _Model:
    def __init__(self, lanes: int, reading: bool):
        self.reading = reading
        self.table2 = np.full(1 << _SLOTS, _NONE << 3, np.int32)  # id * 8 + confidence
        self.table1 = np.full(1 << 16, _NONE << 3, np.int32)
        self.seen = np.zeros((3, 64), np.int64)  # all, hits of order 2, hits of order 1
        self.counts = np.zeros(1 << 16, np.int64)
        self.counts[_NONE] = 1
        self.one = np.full(lanes, _NONE, np.int64)
        self.two = self.one.astype(np.uint32)
        self.recent: list[np.ndarray] = []
        self.step = 0
        self.following = 1
        self.base = np.zeros((64, 4), np.int64)
        self.times = np.zeros((64, 4), np.int64)
        self._order0()
        self._shares()

    def _order0(self) -> None:
        """Parts of 65536 for each id seen and for a new one: first * 2 ** 32 + size."""
        some = np.flatnonzero(self.counts)
        c = self.counts[some]
        size = 1 + c * (65536 - len(some)) // c.sum()
        size[-1] += 65536 - size.sum()  # the last is the new one
        parts = np.cumsum(size) - size << 32 | size
        self.new = parts[-1]
        self.parts = np.full(1 << 16, self.new)
        self.parts[some] = parts
        if self.reading:
            self.which = np.repeat(some.astype(np.int32), size)

    def _shares(self) -> None:
        """What orders 2 and 1 get together, what order 2 gets, and the 256ths left."""
        n, two, one = self.seen
        right = two + one  # n at most, so all three get something
        hits = np.maximum(256 * (right + 1) // (n + 3), 1)
        self.both = hits << 16
        self.part2 = self.both * (two + 1) // (right + 2)
        self.rest = 256 - hits
        # By place: first * 2 ** 32 + size, to which order 0 adds its parts so many times.
        self.base[:, 0] = self.both << 32
        self.base[:, 1] = self.part2 << 32 | self.both - self.part2
        self.base[:, 2:] = self.part2[:, None]
        self.times[:, 0] = self.rest

    def predict(self) -> None:
        one = self.one.astype(np.uint32)
        self.slot = (one * np.uint32(0x9E3779B1) + self.two * np.uint32(0x85EBCA6B) >> 12 & ((1 << _SLOTS) - 1)).astype(np.int64)
        self.two = one
        self.e2, self.e1 = self.table2[self.slot], self.table1[self.one]
        self.guess2, self.guess1 = self.e2 >> 3, self.e1 >> 3
        self.cell = ((self.e2 & 7) << 3 | self.e1 & 7).astype(np.uint8)

    def update(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first and the size of each id's part of 1 << _TOTAL, and which are new."""
        right = (ids == self.guess2).view(np.uint8) << 1 | (ids == self.guess1).view(np.uint8)
        place = (self.cell << 2 | right).astype(np.int64)
        met = ids.astype(np.int64)
        parts = self.parts[met]
        new = (parts == self.new) & (right == 0)
        parts *= self.times.ravel()[place]
        parts += self.base.ravel()[place]
        fresh = (ids << 3) + 1
        for table, at, entry, (add, swap) in ((self.table2, self.slot, self.e2, _LEARN2), (self.table1, self.one, self.e1, _LEARN1)):
            entry += add[place]
            entry ^= (entry ^ fresh) & swap[place]
            table[at] = entry  # of equal places the last counts
        count = np.bincount(place, minlength=256).reshape(64, 4)
        self.seen[0] += count.sum(1)
        self.seen[1] += count[:, 2] + count[:, 3]
        self.seen[2] += count[:, 1]
        full = self.seen[0] > _FULL
        if full.any():
            self.seen[:, full] >>= 1
        self._shares()
        self.one = met
        self.recent.append(met)
        self.step += 1
        if self.step == self.following:  # order 0 is brought up to date ever less often
            self.following += min(1 + self.step // 4, 32)
            count = np.bincount(np.concatenate(self.recent), minlength=1 << 16)
            unseen = count[self.counts == 0].sum()
            self.counts += count
            self.counts[_NONE] = self.counts[_NONE] // 2 + unseen // 2 + 1
            self.recent = []
            self._order0()
        parts = parts.view(np.uint64)
        return parts >> _U(32), parts & _U(0xFFFFFFFF), new


class _Writer:
    def __init__(self, lanes: int, most: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 48) - 1, np.uint64)
        self.words = np.zeros((lanes, most), np.uint16)
        self.flat = self.words.reshape(-1)
        self.at = np.arange(lanes) * most

    def put(self, first: np.ndarray, size: np.ndarray) -> None:
        """A symbol of each lane: its part of 1 << _TOTAL."""
        r = self.range >> _U(_TOTAL)
        low = self.low + r * first
        rng = r * size
        over = np.flatnonzero(low >= _U(1 << 48))
        if len(over):
            at = self.at[over] - 1
            while len(at):
                self.flat[at] += np.uint16(1)
                at = at[self.flat[at] == 0] - 1
        small = rng < _U(1 << 32)
        self.flat[self.at] = low >> _U(32)
        self.at += small
        shift = small.astype(np.uint64) << _U(4)
        self.low = low << shift & _U((1 << 48) - 1)
        self.range = rng << shift
        again = np.flatnonzero(self.range < _U(1 << 32))
        if len(again):
            self.flat[self.at[again]] = self.low[again] >> _U(32)
            self.at[again] += 1
            self.low[again] = (self.low[again] & _U(0xFFFFFFFF)) << _U(16)
            self.range[again] <<= _U(16)

    def finish(self) -> None:
        for _ in range(3):
            self.flat[self.at] = self.low >> _U(32)
            self.at += 1
            self.low = (self.low & _U(0xFFFFFFFF)) << _U(16)


class _Reader:
    def __init__(self, words: np.ndarray, start: np.ndarray):
        self.words = words
        self.at = start + 3
        head = words[start[:, None] + np.arange(3)].astype(np.uint64)
        self.code = (head[:, 0] << _U(32)) | (head[:, 1] << _U(16)) | head[:, 2]
        self.range = np.full(len(start), (1 << 48) - 1, np.uint64)

    def value(self) -> np.ndarray:
        """Which of 1 << _TOTAL parts comes next."""
        self.r = self.range >> _U(_TOTAL)
        return np.minimum(self.code // self.r, _U((1 << _TOTAL) - 1)).astype(np.int32)

    def take(self, first: np.ndarray, size: np.ndarray) -> None:
        code = self.code - self.r * first
        rng = self.r * size
        small = rng < _U(1 << 32)
        shift = small.astype(np.uint64) << _U(4)
        self.code = code << shift | self.words[self.at] * small
        self.range = rng << shift
        self.at += small
        again = np.flatnonzero(self.range < _U(1 << 32))
        if len(again):
            self.code[again] = (self.code[again] << _U(16)) | self.words[self.at[again]]
            self.range[again] <<= _U(16)
            self.at[again] += 1


def _encode_block(ids: np.ndarray) -> bytes:
    """ids and lanes, words of each lane, new ids, words."""
    lanes = min(LANES, -(-len(ids) // STEPS))
    size = -(-len(ids) // lanes)
    padded = np.zeros(lanes * size, np.int32)
    padded[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(lanes, size).T)
    m, out = _Model(lanes, False), _Writer(lanes, 2 * size + 4)
    plain = []
    for x in columns:
        m.predict()
        first, part, new = m.update(x)
        out.put(first, part)
        if new.any():
            plain.append(x[new])
    out.finish()
    count = out.at - np.arange(lanes) * out.words.shape[1]
    used = np.arange(out.words.shape[1]) < count[:, None]
    new = np.concatenate(plain or [np.zeros(0, np.int32)])
    return struct.pack("<III", len(ids), lanes, len(new)) + b"".join(x.tobytes() for x in (count.astype("<u4"), new.astype("<u2"), out.words[used].astype("<u2")))


def _decode_block(data: bytes) -> np.ndarray:
    n, lanes, fresh = struct.unpack("<III", data[:12])
    size = -(-n // lanes)
    count = np.frombuffer(data, "<u4", lanes, 12).astype(np.int64)
    plain = np.frombuffer(data, "<u2", fresh, 12 + 4 * lanes)
    words = np.append(np.frombuffer(data, "<u2", offset=12 + 4 * lanes + 2 * fresh), np.zeros(4, np.uint16))
    m, src = _Model(lanes, True), _Reader(words, np.cumsum(count) - count)
    out = np.empty((size, lanes), np.int32)
    at = 0
    for t in range(size):
        m.predict()
        v = src.value()
        cell = m.cell.astype(np.int64)
        left = v - m.both.astype(np.int32)[cell]
        symbol = m.which[np.maximum(left, 0) // m.rest.astype(np.int32)[cell]]
        x = np.where(left >= 0, symbol, np.where(v < m.part2.astype(np.int32)[cell], m.guess2, m.guess1))
        new = np.flatnonzero(x == _NONE)
        if len(new):
            x[new] = plain[at : at + len(new)]
            at += len(new)
        out[t] = x
        first, part, _ = m.update(x)
        src.take(first, part)
    return out.T.ravel()[:n]


def encode_frame(ids: np.ndarray) -> bytes:
    """A frame of blocks that holds these ids (each below 65535)."""
    if len(ids) and (ids.min() < 0 or ids.max() >= _NONE):
        raise ValueError("ids must be in 0..65534")
    blocks = [_encode_block(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
    index = struct.pack(f"<{2 * len(blocks)}I", *(v for b in blocks for v in (len(b), zlib.crc32(b))))
    head = _MAGIC + struct.pack("<QI", len(ids), len(blocks))
    return b"".join([head, struct.pack("<I", zlib.crc32(head + index)), index, *blocks])


def frame_blocks(frame: bytes) -> Iterator[bytes]:
    """The blocks of a frame, after their checksums."""
    size = len(_MAGIC) + 12
    if frame[: len(_MAGIC)] != _MAGIC:
        raise ValueError("not a frame of ids")
    _, blocks = struct.unpack("<QI", frame[len(_MAGIC) : size])
    (check,) = struct.unpack("<I", frame[size : size + 4])
    index = frame[size + 4 : size + 4 + 8 * blocks]
    if zlib.crc32(frame[:size] + index) != check:
        raise ValueError("the frame's index is damaged")
    at = size + 4 + 8 * blocks
    for k in range(blocks):
        length, check = struct.unpack_from("<II", index, 8 * k)
        block = frame[at : at + length]
        if zlib.crc32(block) != check:
            raise ValueError(f"block {k} is damaged")
        yield block
        at += length


def decode_frame(frame: bytes) -> np.ndarray:
    """The ids of a frame; raises if a checksum fails."""
    return np.concatenate([np.zeros(0, np.int32), *(_decode_block(b) for b in frame_blocks(frame))])
