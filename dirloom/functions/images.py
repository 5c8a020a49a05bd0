"""Width and height of pictures, read from their first bytes.

PNG, GIF, BMP and WebP have them at fixed places and are read by built-in functions.
JPEG and TIFF are chains of segments, walked in one Arrow step that gets only those.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: JPEG segments that hold a frame's size, and those without a length.
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_BARE = frozenset((0x01, *range(0xD0, 0xD9)))


def _number(content: Column, at: int, n: int, little: bool) -> Column:
    """The unsigned number in n bytes from place ``at`` (from 0)."""
    places = range(at + n - 1, at - 1, -1) if little else range(at, at + n)
    return F.conv(F.concat(*(F.hex(F.substring(content, k + 1, 1)) for k in places)), 16, 10).cast("long")


def jpeg_size(raw: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(raw):
        if raw[at] != 0xFF:
            return None
        kind = raw[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind in _BARE:
            at += 2
        elif kind in _FRAMES:
            height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None


def tiff_size(raw: bytes) -> tuple[int, int] | None:
    order = "<" if raw[:2] == b"II" else ">"
    at = struct.unpack(order + "I", raw[4:8])[0] if len(raw) >= 8 else len(raw)
    found = {}
    entries = struct.unpack(order + "H", raw[at : at + 2])[0] if at + 2 <= len(raw) else 0
    for k in range(entries):
        entry = raw[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            break
        tag, kind = struct.unpack(order + "HH", entry[:4])
        found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return (found[0x100], found[0x101]) if {0x100, 0x101} <= found.keys() else None


@F.pandas_udf(LongType())
def _walked(content: pd.Series) -> pd.Series:
    """width * 2 ** 32 + height, null where there is none."""

    def one(raw: bytes | None) -> int | None:
        size = None if raw is None else jpeg_size(bytes(raw)) if raw[:2] == b"\xff\xd8" else tiff_size(bytes(raw))
        return None if size is None else (size[0] << 32) + size[1]

    return pd.Series([one(r) for r in content], dtype="Int64")


def image_size(content: Column, extension: Column) -> Column:
    """Struct (width, height), null where the bytes don't tell; ``extension``: the kind of picture."""

    def number(at: int, n: int, little: bool = True) -> Column:
        return _number(content, at, n, little)

    def both(w: Column, h: Column) -> Column:
        return F.when(w.isNotNull() & h.isNotNull(), F.struct(w.alias("width"), h.alias("height")))

    def signed(c: Column) -> Column:  # a BMP's height is negative where rows run downwards
        return F.when(c >= 1 << 31, (1 << 32) - c).otherwise(c)

    chunk, bits = F.hex(F.substring(content, 13, 4)), number(21, 4)
    webp = F.when(chunk == "56503858", both(number(24, 3) + 1, number(27, 3) + 1)).when(chunk == "56503820", both(number(26, 2) % (1 << 14), number(28, 2) % (1 << 14)))
    webp = webp.when(chunk == "5650384C", both(bits % (1 << 14) + 1, F.floor(bits / (1 << 14)) % (1 << 14) + 1))
    old = number(14, 4) == 12  # the first header of BMP files has numbers of two bytes
    walked = _walked(F.when(extension.isin(".jpg", ".tif"), content))
    enough = lambda n, c: F.when(F.octet_length(content) >= n, c)
    return (
        F.when(extension == ".png", enough(24, both(number(16, 4, False), number(20, 4, False))))
        .when(extension == ".gif", enough(10, both(number(6, 2), number(8, 2))))
        .when(extension == ".bmp", enough(26, F.when(old, both(number(18, 2), number(20, 2))).otherwise(both(number(18, 4), signed(number(22, 4))))))
        .when(extension == ".webp", enough(30, webp))
        .otherwise(both(F.shiftright(walked, 32), walked.bitwiseAND(F.lit((1 << 32) - 1))))
    )
