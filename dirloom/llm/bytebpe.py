"""Byte-level BPE ids of string columns, by the tokenizers library.

The vocabulary's pre-tokenizer cuts a text into pieces that merges never cross,
so the library's model encodes each distinct piece once and columns are put
together by look-up.  The cuts are found on whole buffers for texts of letters up
to U+024F; other texts, and those with an apostrophe before a letter or with a
special token's string, are encoded whole by the library, as are all texts if the
vocabulary cuts or changes them in another way.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import columnar as C
from .segments import SegmentIds

CACHE = 2_000_000
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def _class_of(cp: int) -> int:
    c = chr(cp)
    if c in "\t\n\v\f\r ":
        return _SPACE
    kind = unicodedata.category(c)[0]
    return _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER


_CLASSES = np.array([_class_of(cp) for cp in range(0x250)], np.uint8)
_KINDS = _CLASSES[np.minimum(np.arange(256), 127)]
_LAST_LEAD = 0xC8  # leads U+0200..U+023F
#: Bytes that may send a text to the library: far leads, apostrophes, the lead of U+0085 and U+00A0.
_WATCHED = np.arange(256) > _LAST_LEAD
_WATCHED[[39, 0xC2]] = True
#: What the library's ``ByteLevel`` writes for each byte.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_UNPRINTED = sorted(set(range(256)) - _PRINTED)
_SIGNS = "".join(chr(b) if b in _PRINTED else chr(256 + _UNPRINTED.index(b)) for b in range(256))


def _plain_bytes(library) -> bool:  # noqa: ANN001
    """Whether a text is cut as ``_cuts`` does and nothing else is done to it."""
    spec = json.loads(library.to_str())
    cut = spec["pre_tokenizer"] or {}
    as_is = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
    return as_is and spec["model"]["type"] == "BPE" and not (spec["normalizer"] or spec["truncation"] or spec["padding"])


class ByteEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model if _plain_bytes(self.library) else None
        #: What the vocabulary matches whole, before words are split.
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.table = SegmentIds(self._pieces, CACHE, "latin-1")

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of pieces, given with a character for each byte."""
        signs = "".join(pieces).translate(_SIGNS)
        bounds = pairwise(accumulate(map(len, pieces), initial=0))
        return [[t.id for t in self.model.tokenize(signs[a:z])] for a, z in bounds]

    def _cuts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pieces begin, and the end of the buffer."""
        n = len(buf)
        kind = _KINDS[buf]
        lead = np.flatnonzero(buf >= 0xC0)
        cp = (buf[lead].astype(np.int64) & 0x1F) << 6 | (buf[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = _CLASSES[cp]
        edge = np.zeros(n + 1, bool)
        edge[1:n] = kind[1:] != kind[:-1]
        rows = np.zeros(n + 1, bool)
        rows[off] = True
        edge |= rows
        # A run of spaces before something else leaves its last to what follows.
        inner = np.flatnonzero(edge[1:n] & ~rows[1:n] & (kind[: n - 1] == _SPACE)) + 1
        edge[inner - 1] = True
        edge[inner[buf[inner - 1] == 32]] = False
        return np.flatnonzero(edge)

    def _odd(self, buf: np.ndarray) -> np.ndarray:
        """Bytes that ``_cuts`` can't judge."""
        at = np.flatnonzero(_WATCHED[buf])
        this, following = buf[at], buf[np.minimum(at + 1, len(buf) - 1)]
        quote = (this == 39) & np.isin(following, list(b"stmdrvl"))
        space = (this == 0xC2) & ((following == 0xA0) | (following == 0x85))
        return at[(this > _LAST_LEAD) | quote | space]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets) of a string column; null counts as empty."""
        text = pc.fill_null(column.cast(pa.string()), "")
        buf, off = C.utf8(text)
        rows = len(off) - 1
        odd = np.full(rows, self.model is None)
        odd[np.searchsorted(off, self._odd(buf), "right") - 1] = True
        for s in self.special:
            odd |= pc.match_substring(text, s).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd)
        fast, fast_at = self._encode_plain(text.take(pa.array(plain)))
        if len(plain) == rows:
            return fast, fast_at
        slow = self._library(text.take(pa.array(np.flatnonzero(odd))).to_pylist())
        count = np.zeros(rows, np.int64)
        count[plain] = np.diff(fast_at)
        count[odd] = [len(x) for x in slow]
        at = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(at[-1], np.int32)
        row, within = C.ragged(count)
        mine = ~odd[row]
        out[mine] = fast
        out[~mine] = np.fromiter(chain.from_iterable(slow), np.int32)
        return out, at

    def _encode_plain(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, off = C.utf8(text)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        cut = self._cuts(buf, off)
        starts, ends = cut[:-1], cut[1:]
        at = np.searchsorted(starts, off)
        ids, before = self.table.ids(buf, starts, ends)
        return ids, before[at]


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """This worker's encoder."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]
