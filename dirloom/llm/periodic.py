"""Periodic runs of words: found by block convolution, then collapsed to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are
the same), at least ``max(MIN_WORDS, MIN_POWER * q)`` long, that no neighbouring word
extends with period q.  Every word of it after its first q words is a repetition.

Method, for a batch of texts whose words carry ids 1..V within each text:

* At each scale B = 1, 2, 4, ... a text is cut into blocks of B words.  The sum of
  squared differences between a block and each of the B places at distance B to
  2B - 1 behind it is a convolution, done for all blocks at once by number-theoretic
  transforms of length 2B.  The sum is an exact integer: as many primes are taken as
  make their product exceed V * V * B, so it is zero exactly where the block occurs.
  A block is transformed once; the window behind it is the next two blocks, whose
  transform is a sum of theirs.
* A run of period q in [B, 2B) holds at least two blocks in a row that occur q words
  on, so blocks in a row with one distance are joined into a seed, short seeds are
  left out, and those within a run of smaller period, found at an earlier scale, too
  (by Fine and Wilf's theorem their smallest period is that run's).  Seeds grow to
  both sides by less than B words, word by word.

Cost: O(n log(n)^2) a text of n words whatever its repetitions.  Texts are mapped in
pieces of a few MB and never shuffled; a longer text is one piece, handled in slabs.

Edge cases: null, empty and blank texts have no words and no runs, their collapsed
text is empty; rows repeated or with null ids are handled each on its own; an empty
table gives an empty one; columns that aren't asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import columnar as C
from .storage import free_name, small_batches

MIN_POWER = 4
MIN_WORDS = 6

#: (prime, primitive root): transforms of up to 2 ** 25 words.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
#: Words of a slab of blocks that is transformed at once, and rows it has at least.
SLAB, SLAB_ROWS = 1 << 17, 8
_U = np.uint64
_NO_RUNS = np.zeros((0, 3), np.int64)

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    """x mod p; dividing by a constant is faster than numpy's remainder."""
    q = x // _U(p)
    q *= _U(p)
    x -= q
    return x


@lru_cache(64)
def _twiddles(size: int, prime: int, root: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. size / 2 - 1 of a root of unity of order ``size``, and of its inverse."""
    out = []
    w = pow(root, (prime - 1) // size, prime)
    for base in (w, pow(w, -1, prime)):
        t = np.ones(1, np.uint64)
        while len(t) < size // 2:
            t = np.concatenate([t, _mod(t * _U(pow(base, len(t), prime)), prime)])
        out.append(t[: size // 2])
    return out[0], out[1]


@lru_cache(32)
def _negated(size: int) -> np.ndarray:
    """Where the value of index -j stands, for each place in bit-reversed order."""
    at = np.zeros(1, np.int64)
    while len(at) < size:
        at = np.concatenate([2 * at, 2 * at + 1])
    place = np.empty(size, np.int64)
    place[at] = np.arange(size)
    return place[-at % size]


def _forward(x: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Transforms of the columns of x, each followed by as many zeros, in bit-reversed order."""
    half, rows = x.shape
    p = _U(prime)
    out = np.empty((2 * half, rows), np.uint64)
    out[:half] = x
    out[half:] = _mod(x * _twiddles(2 * half, prime, root)[0][:, None], prime)
    h = half // 2
    while h:
        v = out.reshape(-1, 2, h, rows)
        w = _twiddles(2 * h, prime, root)[0][:, None]
        s = v[:, 0] + v[:, 1]
        d = v[:, 0] + (p - v[:, 1])
        np.minimum(s, s - p, out=v[:, 0])
        v[:, 1] = _mod(d * w, prime) if h > 1 else np.minimum(d, d - p)
        h //= 2
    return out


def _inverse_first_half(x: np.ndarray, prime: int, root: int) -> np.ndarray:
    """The first half of the inverse transforms of x (bit-reversed), times their length."""
    size, rows = x.shape
    p, h = _U(prime), 1
    while h < size:
        v = x.reshape(-1, 2, h, rows)
        w = _twiddles(2 * h, prime, root)[1][:, None]
        b = _mod(v[:, 1] * w, prime) if h > 1 else v[:, 1].copy()
        s = v[:, 0] + b
        if 2 * h == size:
            return np.minimum(s, s - p)[0]
        d = v[:, 0] + (p - b)
        np.minimum(s, s - p, out=v[:, 0])
        np.minimum(d, d - p, out=v[:, 1])
        h *= 2
    raise AssertionError("size is at least 2")


def _zeros(blocks: np.ndarray, whole: np.ndarray, primes: int) -> np.ndarray:
    """blocks: (rows, B).  (B, rows) booleans: a whole block's squared differences to the
    words B + s places on (which stand in the next two rows) are all zero."""
    rows, b = blocks.shape
    found = np.zeros((b, rows), bool)
    step = max(SLAB_ROWS, SLAB // b)
    for i in range(0, rows, step):
        j = min(i + step, rows)
        slab = np.zeros((j - i + 2, b), np.uint64)
        slab[: min(j + 2, rows) - i] = blocks[i : j + 2]
        here = np.broadcast_to(whole[i:j], (b, j - i)).copy()
        for prime, root in PRIMES[:primes]:
            if not here.any():
                break
            p = _U(prime)
            f = _forward(np.ascontiguousarray(slab.T), prime, root)
            window = f[:, 1:-1].copy()
            window[:b] += f[:b, 2:]
            window[b:] += p - f[b:, 2:]
            np.minimum(window, window - p, out=window)
            product = _mod(f[:, :-2][_negated(2 * b)] * window, prime)
            got = _inverse_first_half(product, prime, root)
            sums = np.zeros((j - i + 2) * b + 1, np.uint64)
            flat = slab.ravel()
            np.cumsum(_mod(flat * flat, prime), out=sums[1:])
            of = sums[b:] - sums[:-b]  # squares of the b words from each place
            place = b * np.arange(j - i)
            want = of[place][None, :] + of[(b + place)[None, :] + np.arange(b)[:, None]]
            here &= got == _mod(_mod(want, prime) * _U(b), prime)
        found[:, i:j] = here
    return found


def _contained(start: np.ndarray, end: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which of the spans lie within one of the runs (start, length, period)."""
    if not len(runs) or not len(start):
        return np.zeros(len(start), bool)
    order = np.argsort(runs[:, 0], kind="stable")
    reach = np.maximum.accumulate((runs[:, 0] + runs[:, 1])[order])
    k = np.searchsorted(runs[order, 0], start, "right")
    return (k > 0) & (reach[np.maximum(k, 1) - 1] >= end)


def _same_for(ids: np.ndarray, at: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words from ``at`` on, in steps of 1 or -1, equal the word d places on."""
    out = np.empty(len(at), np.int64)
    batch = max(1, (1 << 20) // most)
    for i in range(0, len(at), batch):
        s = slice(i, i + batch)
        pos = at[s, None] + step * np.arange(most)
        ok = (pos >= lo[s, None]) & (pos + d[s, None] < hi[s, None])
        pos = np.where(ok, pos, lo[s, None])
        far = np.where(ok, pos + d[s, None], pos)
        bad = ~(ok & (ids[pos] == ids[far]))
        out[s] = np.where(bad.any(1), bad.argmax(1), most)
    return out


def find_runs(ids: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, starts counted over all texts.

    ids: word ids, from 1 on within each text; at: text offsets; kinds: ids of each text."""
    size = np.diff(at)
    known = _NO_RUNS
    b = 1
    while len(size) and MIN_POWER * b <= size.max():
        fresh = [known]
        long = size >= max(MIN_POWER * b, MIN_WORDS)
        need = np.ones(len(size), np.int64)
        product = 1
        for k, (prime, _) in enumerate(PRIMES):
            product *= prime
            need[kinds.astype(float) ** 2 * b >= 0.999 * product] = k + 2  # rounding errs to one more
        for primes in np.unique(need[long]):
            if primes > len(PRIMES):
                raise ValueError("a text has too many words")
            texts = np.flatnonzero(long & (need == primes))
            n = size[texts]
            rows = -(-n // b) + 1  # one row without words behind each text
            first = np.cumsum(rows) - rows
            text, within = C.ragged(n)
            flat = np.zeros(rows.sum() * b, np.uint64)
            flat[first[text] * b + within] = ids[at[texts][text] + within]
            row_text, row = C.ragged(rows)
            zero = _zeros(flat.reshape(-1, b), (row + 1) * b <= n[row_text], int(primes))
            width = zero.shape[1]
            hit = np.flatnonzero(zero.ravel())
            if not len(hit):
                continue
            head = np.ones(len(hit), bool)
            head[1:] = (np.diff(hit) > 1) | (hit[1:] % width == 0)
            head = np.flatnonzero(head)
            m = np.diff(np.append(head, len(hit)))
            d, r = hit[head] // width + b, hit[head] % width
            good = (m + 2) * b > (MIN_POWER - 1) * d
            m, d, r = m[good], d[good], r[good]
            lo = at[texts][row_text[r]]
            start = lo + row[r] * b
            hi = at[texts + 1][row_text[r]]
            new = ~_contained(start, start + m * b + d, known)
            m, d, start, lo, hi = m[new], d[new], start[new], lo[new], hi[new]
            left = _same_for(ids, start - 1, d, lo, hi, -1, b)
            right = _same_for(ids, start + m * b, d, lo, hi, 1, b)
            start, length = start - left, m * b + left + right + d
            good = (length >= np.maximum(MIN_POWER * d, MIN_WORDS)) & ~_contained(start, start + length, known)
            fresh.append(np.stack([start, length, d], 1)[good])
        known = np.concatenate(fresh)
        b *= 2
    return known[np.lexsort((known[:, 2], known[:, 0]))]


def _word_ids(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ids from 1 on within each text, text offsets, ids a text, word starts, word ends)."""
    starts, ends, at = C.words(buf, off)
    data = buf[~C.SPACE[buf]]
    ends_in = np.concatenate([[0], np.cumsum(ends - starts)])
    whole = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_in.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    kind = whole.dictionary_encode().indices.to_numpy().astype(np.int64)
    row = C.rows_of(at)
    pairs, inverse = np.unique(row * (len(kind) + 1) + kind, return_inverse=True)
    first = np.searchsorted(pairs, np.arange(len(at)) * (len(kind) + 1))
    return inverse - first[row] + 1, at, np.diff(first), starts, ends


def _collapse(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            buf, off = C.utf8(batch.column("text"))
            ids, at, kinds, starts, ends = _word_ids(buf, off)
            runs = find_runs(ids, at, kinds)
            text = np.searchsorted(at, runs[:, 0], "right") - 1
            drop = np.zeros(len(ids) + 1, np.int64)
            np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
            np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(drop)[:-1] == 0
            # a text's last kept word has no space behind it
            row = C.rows_of(at)[kept]
            size = (ends - starts)[kept] + 1
            if len(row):
                size[np.append(row[1:] != row[:-1], True)] -= 1
            word, within = C.ragged(size)
            source = starts[kept][word] + within
            out = np.where(within < (ends - starts)[kept][word], buf[np.minimum(source, max(len(buf) - 1, 0))] if len(buf) else 0, 32).astype(np.uint8)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(row, weights=size, minlength=len(at) - 1).astype(np.int64))])
            texts = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(out)]).cast(pa.string())
            fields = [runs[:, 0] - at[text], runs[:, 1], runs[:, 2]]
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(at) - 1))]), pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in fields], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(at)), listed, texts], [key, "n_words", "runs", "text"])

    return run


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """``key``, n_words, runs (structs start, length, period by start, then period; places
    are word numbers from 0 on) and text: the words without repetitions, joined by one space."""
    rows = docs.select(F.col(key), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("text", T.StringType())])
    return small_batches(rows).mapInArrow(_collapse(key), schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first.  Null: no run."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.reduce(runs, F.lit(None).cast(RUNS.elementType), lambda best, r: F.when(better(best, r), r).otherwise(best))


def planted(key: Column, text: Column) -> Column:
    """``text`` with a periodic end where the contract of the query says so: for ids whose
    CRC32 h of the decimal id is divisible by 10, each word from a = g % n on (g = h div 10)
    is one of p = 1 + (n - a) div (3 + g % 8) words from a.  A null id plants nothing."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))), " ")

    # the words are split once: as the element of an array of one
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(F.lit(""))), 0)
    return F.when((h % 10 == 0) & text.isNotNull(), made).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document, over its planted text."""
    found = collapse_runs(docs, text=planted(F.col("doc_id"), F.col("text")))
    best = free_name(found, "best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn(best, strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col(best)["start"].alias("start"),
        F.col(best)["length"].alias("length"),
        F.col(best)["period"].alias("period"),
        F.expr(f"1000 * {best}.length div {best}.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )
