"""Chat formatting: conversations as marked-up text with a loss mask.

The template puts each turn between control strings::

    <|turn|>ROLE\\nTEXT<|/turn|>\\n

Control strings inside roles and texts, those of this template and of other
common ones alike, are escaped reversibly: ``\\`` becomes ``\\\\`` and ``\\!`` is
put behind the first character of each, so that it no longer reads as one.

Assembly is columnar: the lengths of all segments of a batch (headers, roles,
texts, footers) give cumulative offsets, from which scatter indices copy every
segment into one preallocated buffer.  It is cut into turns, and the turns of a
part are put together once more as an Arrow string column.

Rows are dealt by conversation and sorted by turn, then formatted as a stream.
A conversation comes out in parts of about ``PART_BYTES`` bytes, numbered from
0, so that even one of a third of all rows never lies in memory whole; the
parts joined are its text, and no turn's span of the loss mask is cut.  The mask
has byte spans (start, length) within the part, one for each text that an
assistant said.

Edge cases: null text or role counts as empty, a null turn sorts first; equal
turns are put in the order of role and text; repeated rows are repeated turns;
a null conv_id is a conversation of its own; a turn without text has an empty
span; a very long turn makes one long part; empty tables give empty results;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as C
from .storage import small_batches

OPEN, CLOSE = "<|turn|>", "<|/turn|>\n"
#: First characters and rests of the control strings that are escaped.
CONTROL = (r"(<)(\||/?s>|</?SYS>>)", r"(\[)(/?INST\])")
PART_BYTES = 1 << 22
SPEAKER = "assistant"
#: A newline inside a role.
NEWLINE = "\\n"


def escape(column: pa.Array) -> pa.Array:
    out = pc.replace_substring(column, "\\", "\\\\")
    for pattern in CONTROL:
        out = pc.replace_substring_regex(out, pattern, r"\1\\!\2")
    return out


_UNESCAPE = re.compile(r"\\([\\!n])")
_MEANS = {"\\": "\\", "!": "", "n": "\n"}


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _MEANS[m[1]], text) if "\\" in text else text


def assemble(columns: list[pa.Array | bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(buffer, row offsets, start of each column's segment in each row) of the
    rows' segments one behind the other; bytes stand for the same segment in each row."""
    rows = next(len(c) for c in columns if not isinstance(c, bytes))
    data, begin, size = [], [], []
    for c in columns:
        if isinstance(c, bytes):
            data.append(np.frombuffer(c, np.uint8))
            begin.append(np.zeros(rows, np.int64))
            size.append(np.full(rows, len(c), np.int64))
        else:
            buf, off = C.utf8(c)
            data.append(buf)
            begin.append(off[:-1])
            size.append(np.diff(off))
    sizes = np.column_stack(size)
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    starts = ends - sizes
    out = np.empty(int(ends[-1, -1]) if rows else 0, np.uint8)
    for k, buf in enumerate(data):
        row, within = C.ragged(sizes[:, k])
        out[starts[row, k] + within] = buf[begin[k][row] + within]
    row_off = np.append(starts[:, 0], len(out)) if rows else np.zeros(1, np.int64)
    return out, row_off, [starts[:, k] for k in range(len(columns))]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, part, held, size = None, 0, [], 0  # of the conversation that is open
    names = ["conv_id", "part", "formatted", "loss"]
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])

    def flush(ids: list, parts: list, texts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        data = [t for t, _ in texts]
        off = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int32)
        buffer = np.concatenate(data) if data else np.zeros(0, np.uint8)
        formatted = pa.StringArray.from_buffers(len(data), pa.py_buffer(off), pa.py_buffer(buffer))
        masks = np.concatenate([m for _, m in texts]) if texts else np.zeros((0, 2), np.int64)
        values = pa.StructArray.from_arrays([pa.array(masks[:, 0]), pa.array(masks[:, 1])], fields=list(span))
        at = np.concatenate([[0], np.cumsum([len(m) for _, m in texts])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), formatted, pa.ListArray.from_arrays(pa.array(at), values)], names)

    def joined() -> tuple[np.ndarray, np.ndarray]:
        base, masks = 0, []
        for t, m in held:
            masks.append(m + np.array([base, 0]))
            base += len(t)
        return np.concatenate([t for t, _ in held]), np.concatenate(masks)

    open_ = False
    for b in C.pieces(batches):
        role, text = (escape(pc.fill_null(b.column(c), "")) for c in ("role", "text"))
        role = pc.replace_substring(role, "\n", NEWLINE)
        buf, off, starts = assemble([OPEN.encode(), role, b"\n", text, CLOSE.encode()])
        spoken = pc.fill_null(pc.equal(b.column("role"), SPEAKER), False).to_numpy(zero_copy_only=False)
        length = starts[4] - starts[3]
        ids = b.column("conv_id").to_pylist()
        out_ids, out_parts, out = [], [], []
        i = 0
        while i < len(ids):
            j = i + 1
            while j < len(ids) and ids[j] == ids[i]:
                j += 1
            if open_ and (ids[i] != conv or size >= PART_BYTES):
                out_ids.append(conv)
                out_parts.append(part)
                out.append(joined())
                part = part + 1 if ids[i] == conv else 0
                held, size = [], 0
            conv, open_ = ids[i], True
            mine = np.arange(i, j)[spoken[i:j]]
            held.append((buf[off[i] : off[j]], np.column_stack([starts[3][mine] - off[i], length[mine]])))
            size += int(off[j] - off[i])
            i = j
        if out:
            yield flush(out_ids, out_parts, out)
    if open_:
        yield flush([conv], [part], [joined()])


FORMATTED = "conv_id long, part long, formatted string, loss array<struct<start: long, length: long>>"


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, loss); the parts of a conversation lie in one
    partition, in order."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return small_batches(rows).select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of whole turns of formatted text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        end = formatted.index(CLOSE, at)
        role, _, text = formatted[at + len(OPEN) : end].partition("\n")
        yield unescape(role), unescape(text)
        at = end + len(CLOSE)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def fresh() -> dict:
        return {"n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}

    def row(conv: int | None, s: dict) -> tuple:
        return conv, s["n_turns"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"]

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv, s = None, None
    for b in batches:
        done = []
        for c, part, text, spans in zip(*(b.column(k).to_pylist() for k in ("conv_id", "part", "formatted", "loss")), strict=True):
            if part == 0:
                if s is not None:
                    done.append(row(conv, s))
                conv, s = c, fresh()
            for role, said in parse(text):
                s["n_turns"] += 1
                s["turns"].update(f"{role}\n{said}\n".encode())
            s["chars"] += len(text)
            raw = text.encode()
            for m in spans:
                said = unescape(raw[m["start"] : m["start"] + m["length"]].decode())
                s["loss_chars"] += len(said)
                s["loss"].update(said.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
    if s is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row(conv, s), kinds, strict=True)], names)


def conversation_report(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from the output of ``format_conversations``."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(_read_back, schema)
