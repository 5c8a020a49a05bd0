"""Suffix-array deduplication: remove every byte inside a repeated 200-byte string.

The matches are decided by a column-wise construction over many strings: in
each round one symbol of every string is inserted, from its end to its start,
into the collection's Burrows-Wheeler transform, and the common prefixes of
neighbouring suffixes are updated with it (``bwt_lcp``).  The transform and the
prefixes of the rounds lie in two sequential files that each round reads once
and writes once.  Suffixes whose prefix of ``length`` bytes equals a
neighbour's are the repeated strings.

One transform over a whole corpus needs as many rounds as the longest document
has bytes, and each scans everything.  So the corpus is first cut into small
collections that can't miss a match.  Each window of ``length`` bytes is
assigned to the smallest hashed ``GRAM``-byte string in it; equal windows have
equal anchors at equal places.  The windows of one anchor form a segment of up
to 2 * length bytes.  A symbol is WORD bytes wide, so a collection takes at most
2 * length / WORD rounds:

* a segment that equals another whole segment is repeated in full;
* an anchor that occurs once has no repeated window;
* the segments of the other anchors, one of each kind, go by anchor into
  collections of a few hundred segments, for ``bwt_lcp``.

An anchor with more than ``MOST_KINDS`` kinds of segments (a passage of a great
many documents) is first cut into single windows, which are grouped by a digest
of 128 bits with partial aggregation, so that no task holds it whole.

Whole copies: a text that occurs twice loses everything (if it has ``length``
bytes), and one copy stands for all in what follows.

Texts are the same if their 128-bit digests are; segments of one anchor if two
unlike hashes, of 64 and 31 bits, are; windows inside the collections if their
bytes are.

Edge cases: null or empty texts and texts under ``length`` bytes lose nothing
and match nothing; repeated rows are copies of each other; null doc_ids are
kept; empty tables give empty results; further columns stay in
``remove_repeats`` and are ignored by ``repeat_report``.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columnar as C
from .storage import Scratch, free_name, only_ids, without_ids

LENGTH = 200
GRAM = 40
#: Kinds of segments of one anchor that one collection may hold.
MOST_KINDS = 4096
#: Strings of a collection, unless one anchor has more.
COLLECTION = 400
#: Bytes of a symbol; divides LENGTH.
WORD = 8
#: The digest of a text, which stands for it.
TEXT = ["tid", "t2"]
_U = np.uint64
_POS_BITS = 22
_CHUNK = 1 << 19


def bwt_lcp(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, common prefix with the one before) of all suffixes, sorted.

    ``text`` holds the strings, of ``size`` symbols each, one behind the other;
    symbols are unsigned and at least 1.  The end of a string sorts before any
    symbol, ends in the order of the strings.
    """
    m = len(size)
    size = size.astype(np.int32)
    begin = (np.cumsum(size) - size).astype(np.int64)
    text = np.append(text, text.dtype.type(0))
    # State after round j: the suffixes of up to j symbols in order.
    sid = np.arange(m, dtype=np.int32)
    length = np.zeros(m, np.int16)
    short = np.uint8 if size.max(initial=0) < 255 else np.int16

    def preceding(sid: np.ndarray, length: int) -> np.ndarray:
        """The symbol before each suffix; 0 before a whole string."""
        left = size[sid] - length
        return np.where(left > 0, text[begin[sid] + left - 1], 0).astype(text.dtype)

    with tempfile.TemporaryDirectory() as d, contextlib.ExitStack() as files:
        # Opened once and overwritten in place: the columns only grow.
        bwt_file, lcp_file = (files.enter_context(open(f"{d}/{name}", "w+b", buffering=0)) for name in ("bwt", "lcp"))

        def put(f, column: np.ndarray) -> None:  # noqa: ANN001
            f.seek(0)
            f.write(memoryview(column))

        def get(f, kind: np.dtype) -> np.ndarray:  # noqa: ANN001
            f.seek(0)
            return np.fromfile(f, kind)

        put(bwt_file, preceding(sid, 0))
        put(lcp_file, np.zeros(m, short))
        for j in range(int(size.max(initial=0))):
            bwt, lcp = get(bwt_file, text.dtype), get(lcp_file, short)
            new = np.flatnonzero((length == j) & (bwt > 0))  # these get a symbol more
            order = np.argsort(bwt, kind="stable")
            symbol = bwt[order]
            skip = int(np.searchsorted(symbol, 1))
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            # The image of each position under the last-to-first mapping, after the m empty suffixes.
            at = rank[new]
            target = at - skip + m
            n = len(order) - skip + m
            old = np.ones(n, bool)
            old[target] = False
            levels = [lcp]  # level k: the least of 2 ** k from each place on
            while len(levels[-1]) > 1 << (len(levels) - 1):
                last, step = levels[-1], 1 << (len(levels) - 1)
                levels.append(np.minimum(last[:-step], last[step:]))
            table = np.zeros((len(levels), len(lcp)), lcp.dtype)
            for k, level in enumerate(levels):
                table[k, : len(level)] = level

            def least(a: np.ndarray, b: np.ndarray, table: np.ndarray = table) -> np.ndarray:
                """The least common prefix over each [a, b), of at least one place."""
                k = np.frexp((b - a).astype(np.float64))[1] - 1
                return np.minimum(table[k, a], table[k, b - (1 << k)])

            # The symbol's occurrences before and after: one symbol more than the least on the way.
            before = np.flatnonzero((at > 0) & (symbol[at - 1] == symbol[at]))
            nxt = np.minimum(at + 1, len(order) - 1)
            after = np.flatnonzero((nxt > at) & (symbol[nxt] == symbol[at]))
            up = np.zeros(len(new), short)
            up[before] = least(order[at[before] - 1] + 1, new[before] + 1) + 1
            down = least(new[after] + 1, order[nxt[after]] + 1) + 1
            out_lcp, out_sid, out_len, out_bwt = np.empty(n, short), np.empty(n, np.int32), np.empty(n, np.int16), np.empty(n, text.dtype)
            out_lcp[old], out_sid[old], out_len[old], out_bwt[old] = lcp, sid, length, bwt
            out_sid[target], out_len[target], out_bwt[target] = sid[new], j + 1, preceding(sid[new], j + 1)
            out_lcp[target[after] + 1] = down
            out_lcp[target] = up
            sid, length = out_sid, out_len
            put(bwt_file, out_bwt)
            put(lcp_file, out_lcp)
        lcp = get(lcp_file, short)
    return sid, size[sid] - length, lcp


def repeated_windows(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of the windows of ``length`` bytes that occur more than once.

    Symbols are WORD bytes wide: a segment gives one string for each of the WORD
    phases, so that every byte starts a suffix and a round covers WORD bytes.
    """
    size = np.array([len(s) for s in segments])
    data = np.frombuffer(b"".join(segments) + bytes(WORD), np.uint8)
    begin = np.cumsum(size) - size
    word = np.zeros(len(data) - WORD, np.uint64)
    for k in range(WORD):
        word = word << _U(8) | data[k : k + len(word)]
    phases = np.minimum(size - length, WORD - 1) + 1
    seg, phase = C.ragged(phases)
    count = (size[seg] - phase) // WORD
    string, k = C.ragged(count)
    symbols = word[begin[seg[string]] + phase[string] + WORD * k]
    values, dense = np.unique(symbols, return_inverse=True)
    dense = (dense + 1).astype(np.uint16 if len(values) < 65535 else np.uint32)
    sid, start, lcp = bwt_lcp(dense, count)
    same = np.append(lcp >= length // WORD, False)
    hit = np.flatnonzero(same[:-1] | same[1:])
    return seg[sid[hit]], phase[sid[hit]] + WORD * start[hit]


def _anchors(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, anchor's place after it, further windows, anchor, segment) of each segment."""
    n = len(buf)
    w = length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    p, inv = C._powers(n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(C._BYTES[buf] * p[:n], out=prefix[1:])
    grams = C.mix((prefix[GRAM:] - prefix[:-GRAM]) * inv[: n - GRAM + 1])
    key = (grams >> _U(_POS_BITS) << _U(_POS_BITS)) | np.arange(len(grams), dtype=np.uint64)
    pad = (-len(key)) % w
    block = np.concatenate([key, np.full(pad, ~_U(0))]).reshape(-1, w)
    left = np.minimum.accumulate(block, 1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - length + 1
    anchor = (np.minimum(right[:windows], left[w - 1 : w - 1 + windows]) & _U((1 << _POS_BITS) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - length + 1, 0))
    start, within = C.ragged(np.maximum(np.diff(off) - length + 1, 0))
    start = off[start] + within
    a = anchor[start]
    edge = np.ones(len(start), bool)
    edge[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(edge)
    lo, more = start[at], np.diff(np.append(at, len(start))) - 1
    a, row = a[at], row[at]
    segment = (prefix[lo + more + length] - prefix[lo]) * inv[lo]
    p, inv = C._powers31(n + 1)
    prime = _U(C._PRIME)
    prefix[0] = 0
    np.cumsum((C._BYTES[buf] & _U(0x3FFFFFFF)) * p[:n] % prime, out=prefix[1:])
    second = (prefix[lo + more + length] - prefix[lo]) % prime * inv[lo] % prime
    shape = second << _U(20) | ((a - lo) * 1024 + more).astype(np.uint64)
    return row, lo - off[row], a - lo, more, grams[a], C.mix(segment ^ C.mix(shape + _U(1)))


def _segments(length: int):
    def of_text(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        if len(buf) <= _CHUNK:
            return _anchors(buf, off, length)
        at, got = 0, []
        while True:
            part = buf[at : at + _CHUNK]
            found = list(_anchors(part, np.array([0, len(part)]), length))
            last = at + len(part) >= len(buf)
            if not last:  # the last segment may go on: begin the next part with it
                keep = slice(0, -1)
                go_on = at + int(found[1][-1])
                found = [x[keep] for x in found]
            found[1] = found[1] + at
            got.append(found)
            if last:
                return tuple(np.concatenate(x) for x in zip(*got, strict=True))
            at = go_on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches, most=_CHUNK):
            buf, off = C.utf8(b.column("text"))
            ids = _text_ids(buf, off)
            row, lo, left, more, anchor, segment = of_text(buf, off)
            cols = [anchor.view(np.int64), segment.view(np.int64), *(x.to_numpy()[row] for x in ids), (lo << 20) | (left << 10) | more]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "segment", "tid", "t2", "place"])

    return run


def _text_ids(buf: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    """The digest of each text, in two halves."""
    digests = b"".join(hashlib.blake2b(buf[a:b], digest_size=16).digest() for a, b in zip(off[:-1], off[1:], strict=True))
    both = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.pieces(batches):
        buf, off = C.utf8(b.column("text"))
        sha = [hashlib.sha256(buf[x:y]).hexdigest() for x, y in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), *_text_ids(buf, off), pa.array(sha)], ["doc_id", "n_bytes", "tid", "t2", "sha"])


def _with_tid(columns: list[str], tid: str = "tid", t2: str = "t2"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            yield pa.RecordBatch.from_arrays([*_text_ids(*C.utf8(b.column("text"))), *(b.column(c) for c in columns)], [tid, t2, *columns])

    return run


def _cut(length: int):
    """The bytes of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            rows: dict[str, list] = {k: [] for k in ("anchor", "tid", "t2", "place", "resolved", "hot", "bytes")}
            for tid, t2, text, wanted in zip(*(b.column(c).to_pylist() for c in ("tid", "t2", "text", "wanted")), strict=True):
                raw = text.encode()
                for s in wanted:
                    lo, more = s["place"] >> 20, s["place"] & 1023
                    for k in ("anchor", "place", "resolved", "hot"):
                        rows[k].append(s[k])
                    rows["tid"].append(tid)
                    rows["t2"].append(t2)
                    rows["bytes"].append(raw[lo : lo + more + length])
            kinds = {"resolved": pa.bool_(), "hot": pa.bool_(), "bytes": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()], list(rows))

    return run


def _match(length: int):
    """Rows sorted by anchor: the repeated windows (tid, t2, b, e) of the unresolved segments."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        seg, start = repeated_windows([x[5] for x in held], length)
        resolved = np.array([x[4] for x in held], bool)
        keep = np.flatnonzero(~resolved[seg])
        order = np.lexsort((start[keep], seg[keep]))
        s, p = seg[keep][order], start[keep][order]
        out: list[list[int]] = [[], [], [], []]
        if len(s):
            cut = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)))
            stop = np.append(cut[1:], len(s)) - 1
            for a, z in zip(cut, stop, strict=True):
                _, tid, t2, place, _, _ = held[s[a]]
                for o, v in zip(out, (tid, t2, (place >> 20) + int(p[a]), (place >> 20) + int(p[z]) + length), strict=True):
                    o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["tid", "t2", "b", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], []
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("anchor", "tid", "t2", "place", "resolved", "bytes")), strict=True):
                if group and group[0][0] != x[0]:
                    if len(held) + len(group) > COLLECTION and held:
                        yield solve(held)
                        held = []
                    held += group
                    group = []
                group.append(x)
        held += group
        if held:
            yield solve(held)

    return run


def _windows(length: int):
    """Each window of a segment: its place by the anchor, two digests, and where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in range(7)]
            for anchor, tid, t2, place, resolved, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "tid", "t2", "place", "resolved", "bytes")), strict=True):
                lo, left, more = place >> 20, place >> 10 & 1023, place & 1023
                for k in range(more + 1):
                    d = hashlib.blake2b(raw[k : k + length], digest_size=16).digest()
                    for o, v in zip(out, (anchor, left - k, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), tid, t2, (lo + k) * 2 + resolved), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["anchor", "rel", "w1", "w2", "tid", "t2", "at"])

    return run


def _split_hot(hot: DataFrame, length: int) -> DataFrame:
    each = hot.mapInArrow(C.released(_windows(length)), "anchor long, rel long, w1 long, w2 long, tid long, t2 long, at long")
    by = ["anchor", "rel", "w1", "w2"]
    seen = each.groupBy(*by).agg(F.count("*").alias("c"), F.max(F.col("at") % 2).alias("r")).filter("c > 1 or r = 1").drop("c", "r")
    return each.filter("at % 2 = 0").join(seen, by, "left_semi").select("tid", "t2", F.expr("at div 2").alias("b"), F.expr(f"at div 2 + {length}").alias("e"))


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int, scratch: Scratch, most_kinds: int = MOST_KINDS) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): doc_id, n_bytes, TEXT, sha, copies of each row; TEXT, spans of texts that occur once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    about = scratch.save(docs.select("doc_id", "text").mapInArrow(_describe, f"doc_id {kind}, n_bytes long, tid long, t2 long, sha string"), "about")
    kinds = scratch.save(about.groupBy(*TEXT, "n_bytes").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep")), "kinds")
    texts = about.join(kinds.drop("rep"), [*TEXT, "n_bytes"])

    found = scratch.save(docs.select("text").mapInArrow(_segments(length), "anchor long, segment long, tid long, t2 long, place long"), "anchors")
    spot = F.struct(*TEXT, "place")
    classes = found.groupBy("anchor", "segment").agg(F.min(spot).alias("one"), F.max(spot).alias("two"))
    classes = classes.select("anchor", "segment", "one", (F.col("one") != F.col("two")).alias("resolved"))
    classes = scratch.save(classes, "classes")
    scratch.release()
    single = without_ids(found, kinds.filter("copies > 1").select(*TEXT), TEXT)
    whole = single.join(classes.filter("resolved").select("anchor", "segment"), ["anchor", "segment"], "left_semi")
    lo, more = F.expr("place div 1048576"), F.expr("place % 1024")
    spans = whole.select(*TEXT, lo.alias("b"), (lo + more + length).alias("e"))

    open_ = classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("resolved").alias("done")).filter("kinds > 1 and not done")
    wanted = classes.join(open_.select("anchor", (F.col("kinds") > most_kinds).alias("hot")), "anchor")
    wanted = wanted.select("one.tid", "one.t2", F.struct("anchor", F.col("one.place").alias("place"), "resolved", "hot").alias("s"))
    per_text = wanted.groupBy(*TEXT).agg(F.collect_list("s").alias("wanted"))
    reps = kinds.filter(F.col("n_bytes") >= length).select(*TEXT, "rep")
    per_text = scratch.save(per_text.join(reps, TEXT), "wanted")
    key = F.xxhash64("doc_id")  # of a null, too
    some = only_ids(docs.select("doc_id", "text", key.alias("_k")), per_text.select(F.xxhash64("rep").alias("_k")).distinct(), "_k")
    here = some.select("doc_id", "text").mapInArrow(_with_tid(["doc_id", "text"]), f"tid long, t2 long, doc_id {kind}, text string")
    cut = here.join(per_text, TEXT).filter(F.col("doc_id").eqNullSafe(F.col("rep"))).select(*TEXT, "text", "wanted")
    pieces = cut.mapInArrow(C.released(_cut(length)), "anchor long, tid long, t2 long, place long, resolved boolean, hot boolean, bytes binary")
    pieces = scratch.save(pieces.dropDuplicates(["anchor", *TEXT, "place"]), "segments")
    scratch.release()
    cool = pieces.filter("not hot").repartition("anchor").sortWithinPartitions("anchor")
    matched = cool.select("anchor", *TEXT, "place", "resolved", "bytes").mapInArrow(C.released(_match(length)), "tid long, t2 long, b long, e long")
    spans = spans.unionByName(without_ids(matched.unionByName(_split_hot(pieces.filter("hot"), length)), kinds.filter("copies > 1").select(*TEXT), TEXT))
    per = spans.groupBy(*TEXT).agg(F.sort_array(F.collect_set(F.struct("b", "e"))).alias("spans"))
    per = scratch.save(per, "spans")
    scratch.keep(about, kinds, per)
    return texts, per


def merged(spans: list) -> np.ndarray:
    """Sorted spans (b, e) as disjoint, non-adjacent ones."""
    out: list[list[int]] = []
    for s in spans:
        b, e = s["b"], s["e"]
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return np.array(out, np.int64).reshape(-1, 2)


def _kept(raw: bytes, spans: np.ndarray) -> bytes:
    at, parts = 0, []
    for b, e in spans:
        parts.append(raw[at:b])
        at = e
    return b"".join([*parts, raw[at:]])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.pieces(batches):
        removed, count, sha = [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            m = merged(spans)
            removed.append(int((m[:, 1] - m[:, 0]).sum()))
            count.append(len(m))
            sha.append(hashlib.sha256(_kept(text.encode(), m)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("tid"), b.column("t2"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["tid", "t2", "n_removed", "n_spans", "new_sha"])


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def repeat_report(spark: SparkSession, docs: DataFrame, length: int = LENGTH, most_kinds: int = MOST_KINDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    scratch = Scratch(spark, "suffix-dedup")
    texts, spans = repeated_spans(spark, docs, length, scratch, most_kinds)
    here = docs.select("text").mapInArrow(_with_tid(["text"]), "tid long, t2 long, text string")
    cut = only_ids(here, spans.select(*TEXT), TEXT).join(spans, TEXT).select(*TEXT, "text", "spans")
    cut = cut.mapInArrow(_digest, "tid long, t2 long, n_removed long, n_spans long, new_sha string")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return texts.join(cut, TEXT, "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
    )


def _shorten(spans_column: str):
    def whole_characters(raw: bytes, spans: np.ndarray) -> np.ndarray:
        """Spans without the parts of characters that they hold in part only."""
        out = []
        for b, e in spans.tolist():
            while b < e and raw[b] & 0xC0 == 0x80:
                b += 1
            while e > b and e < len(raw) and raw[e] & 0xC0 == 0x80:
                e -= 1
            out.append((b, e))
        return np.array(out, np.int64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            texts = []
            for text, spans in zip(b.column("text").to_pylist(), b.column(spans_column).to_pylist(), strict=True):
                if text is None or not spans:
                    texts.append(text)
                    continue
                raw = text.encode()
                m = merged(spans)
                texts.append(_kept(raw, whole_characters(raw, m)).decode())
            names = [c for c in b.schema.names if c != spans_column]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names)

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``, at whole characters
    (one that a span's edge splits stays), and n_chars, if there, counted anew."""
    scratch = Scratch(spark, "suffix-dedup")
    texts, spans = repeated_spans(spark, docs, length, scratch)
    names = docs.columns
    ids = [free_name(docs, c) for c in TEXT]
    column = free_name(docs, "spans")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("b"), F.col("n_bytes").alias("e")))
    copies = texts.filter((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select(*TEXT, all_.alias("spans")).dropDuplicates(TEXT)
    gone = scratch.save(copies.unionByName(spans).toDF(*ids, column), "gone")
    scratch.keep(gone)
    here = docs.mapInArrow(_with_tid(names, *ids), f"{ids[0]} long, {ids[1]} long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    which = gone.select(*ids)
    hit = only_ids(here, which, ids)
    out = hit.join(gone, ids, "left").drop(*ids).mapInArrow(_shorten(column), docs.schema)
    if hit is not here:  # the other texts need no shuffle
        out = out.unionByName(here.join(F.broadcast(which), ids, "left_anti").drop(*ids))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*names)
    return out
