"""Benchmark decontamination: word-pair seeds, counted along diagonals, then
Smith-Waterman alignment.

Words are runs of letters and digits, ASCII letters lower-cased.  Each candidate
passage is aligned with the item word by word (match 1, other word or gap -1);
the best local score divided by the item's length is the similarity, so that
copies with replaced, lost or added words score high.

A few everyday words say nothing about where a text comes from, so a similarity of
``MIN_SCORE`` counts only if the local score itself is ``MIN_WORDS`` or more.  An item
with fewer words must occur whole; one of fewer than ``SHORT_WORDS`` words ("yes", "of
the people") is met only by a document that says nothing else.

Every two neighbouring words of a test item are a seed.  An alignment of score S
has E errors and S + E matches in at most E + 1 runs, so it holds S - 1 seeds at
least, and as S is ``MIN_SCORE`` of the item's m words or more its gaps shift
the diagonal by m / 2 at most.  A passage is aligned wherever so many seeds lie
on diagonals that close, so none that scores enough is missed.  The seeds
that are looked for are an item's rarest: its commonest ones (by documents that hold
them, from a first pass) are left out, half as many as an alignment must have, and as
many fewer are asked for, so that none can be lost that way.

Both passes read the documents without a shuffle; items travel to them as a
broadcast of at most ``BLOCK_WORDS`` words.  A larger benchmark is taken in
blocks of that size, each against all documents.

Edge cases: null or empty texts and items match nothing; repeated documents and items each give their pairs; a
passage that occurs again in a document gives its best score; tables may be
empty; further columns are kept by ``drop_contaminated`` and otherwise ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as C
from .storage import small_batches

SEED = 2
MIN_SCORE = 0.5
#: Score that an alignment has at least, and words of an item that may occur within a text.
MIN_WORDS, SHORT_WORDS = 8, 4
BLOCK_WORDS = 1_000_000
_CELLS = 1 << 20
#: Hits of seeds that are held at once, but for those of a single text.
_HITS = 1 << 22

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, off = C.utf8(column)
    starts, ends = C._runs(_WORD[buf], off)
    return C.hash_spans(C.LOWER[buf], starts, ends), np.searchsorted(starts, off)


def _seeds(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the seeds of each row; shorter rows are one seed."""
    grams, first = C.ngrams(h, at, SEED)
    count = np.diff(at)
    for k in range(1, SEED):
        short = np.flatnonzero(count == k)
        g, f = C.ngrams(h, at, k)
        own = np.isin(f, at[short])
        grams, first = np.concatenate([grams, g[own] ^ np.uint64(k)]), np.concatenate([first, f[own]])
    return grams, first


class Items:
    """A block of test items, indexed by seed."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.words, self.at = _word_hashes(pa.array(texts, pa.string()))
        grams, first = _seeds(self.words, self.at)
        item = np.searchsorted(self.at, first, "right") - 1
        order = np.argsort(grams, kind="stable")
        self.seeds, begin = np.unique(grams[order], return_index=True)
        self.begin = np.append(begin, len(order))
        self.item, self.pos = item[order], (first - self.at[item])[order]
        self.size = np.diff(self.at)
        self.shortest = int(self.size[self.size > 0].min(initial=SEED))
        #: Score that counts, and seeds that such an alignment has.
        self.least = np.minimum(np.maximum(np.ceil(MIN_SCORE * self.size).astype(np.int64), MIN_WORDS), self.size)
        self.need = np.maximum(self.least - 1, 1)

    def leave_out(self, n: np.ndarray) -> None:
        """Take out the seeds of each item that most documents hold (``n`` by seed), and ask for fewer."""
        seed = np.repeat(np.arange(len(self.seeds)), np.diff(self.begin))
        order = np.lexsort((-n[seed], self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        fewer = (self.need - 1) // 2
        stays = np.ones(len(seed), bool)
        stays[order] = rank >= fewer[item]
        self.need = self.need - fewer
        self.item, self.pos, seed = self.item[stays], self.pos[stays], seed[stays]
        used, self.begin = np.unique(seed, return_index=True)
        self.begin = np.append(self.begin, len(seed))
        self.seeds = self.seeds[used]

    def find(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, seed) of the places where texts hold a seed."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, found = [], []
        for k in range(min(self.shortest, SEED), SEED + 1):
            grams, first = C.ngrams(h, at, k)
            if k < SEED:
                grams = grams ^ np.uint64(k)
            i = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
            hit = np.flatnonzero(self.seeds[i] == grams)
            places.append(first[hit])
            found.append(i[hit])
        return np.concatenate(places), np.concatenate(found)


def _seed_counts(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.seeds), np.int64)
        for b in C.pieces(batches):
            h, at = _word_hashes(b.column("text"))
            place, seed = items.find(h, at)
            row = np.searchsorted(at, place, "right") - 1
            once = np.unique(row * len(total) + seed) % max(len(total), 1)
            total += np.bincount(once, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seed", "n"])

    return run


def align(item: list[np.ndarray], passage: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair of word-hash arrays."""
    m, n = max(map(len, item)), max(map(len, passage))
    a = np.zeros((len(item), m), np.uint64)  # 0 and 1 never match
    b = np.ones((len(item), n), np.uint64)
    for k, (x, y) in enumerate(zip(item, passage, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    step = np.arange(n, dtype=np.int32)
    h = np.zeros((len(item), n + 1), np.int32)
    best = np.zeros(len(item), np.int32)
    for i in range(m):
        s = np.where(b == a[:, i : i + 1], 1, -1).astype(np.int32)
        t = np.maximum(np.maximum(h[:, :-1] + s, h[:, 1:] - 1), 0)
        t = np.maximum.accumulate(t + step, 1) - step  # gaps in the item
        h[:, 1:] = t
        best = np.maximum(best, t.max(1))
    return best


def _matches(items: Items, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, score) of the pairs that score enough."""
    place, seed = items.find(h, at)
    count = items.begin[seed + 1] - items.begin[seed]
    if count.sum() > _HITS and len(at) > 2:
        half = len(at) // 2
        a = _matches(items, h[: at[half]], at[: half + 1])
        b = _matches(items, h[at[half] :], at[half:] - at[half])
        return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])
    k, within = C.ragged(count)
    post = items.begin[seed[k]] + within
    item, word = items.item[post], place[k]
    row = np.searchsorted(at, word, "right") - 1
    diagonal = word - items.pos[post]
    pair = row * len(items.size) + item
    order = np.lexsort((diagonal, pair))
    row, item, diagonal, pair = row[order], item[order], diagonal[order], pair[order]
    if not len(row):
        return row, item, np.zeros(0)
    # Runs of ``need`` hits of a pair within m / 2 diagonals; overlapping runs are one passage.
    need = items.need[item]
    last = np.arange(len(row)) + need - 1
    end = np.minimum(last, len(row) - 1)
    start = np.flatnonzero((last < len(row)) & (pair[end] == pair) & (diagonal[end] - diagonal <= items.size[item] // 2))
    if not len(start):
        return row[:0], item[:0], np.zeros(0)
    cut = np.ones(len(start), bool)
    cut[1:] = (pair[start[1:]] != pair[start[:-1]]) | (diagonal[start[1:]] - diagonal[start[:-1]] > items.size[item[start[1:]]])
    begin = start[cut]
    end = last[np.append(start[np.flatnonzero(cut)[1:] - 1], start[-1])] + 1
    out, words = np.zeros(len(begin)), np.diff(at)
    held: list[int] = []
    cells = 0

    def passage(c: int) -> np.ndarray:
        size = items.size[item[begin[c]]]
        pad = size // 2
        lo = max(at[row[begin[c]]], diagonal[begin[c]] - pad)
        return h[lo : min(at[row[begin[c]] + 1], diagonal[end[c] - 1] + size + pad)]

    def flush() -> None:
        if held:
            which = [item[begin[c]] for c in held]
            best = align([items.words[items.at[i] : items.at[i + 1]] for i in which], [passage(c) for c in held])
            enough = (best >= items.least[which]) & ((items.size[which] >= SHORT_WORDS) | (items.size[which] == words[row[begin[held]]]))
            out[held] = np.where(enough, best / items.size[which], 0)
        held.clear()

    for c in np.argsort(items.size[item[begin]], kind="stable").tolist():
        held.append(c)
        cells += len(passage(c))
        if cells > _CELLS // 16:
            flush()
            cells = 0
    flush()
    good = out > 0
    r, i, s = row[begin][good], item[begin][good], out[good]
    order = np.lexsort((-s, i, r))
    r, i, s = r[order], i[order], s[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
    return r[first], i[first], s[first]


def item_blocks(docs: DataFrame, benchmark: DataFrame, words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark in blocks of about ``words`` words, without each item's commonest seeds."""
    small_batches(docs)
    size = benchmark.agg(F.sum(F.length("text")).alias("c")).first()["c"] or 0
    blocks = 1 + size // (4 * words)
    dealt = benchmark.select("item_id", "text").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        rows = dealt.filter(F.col("block") == k).select("item_id", "text").toArrow()  # bounded by the block's size
        items = Items(rows["item_id"].to_pylist(), rows["text"].to_pylist())
        counted = docs.select("text").mapInArrow(_seed_counts(items), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
        n = np.zeros(len(items.seeds), np.int64)
        got = counted.toPandas()  # a row per seed at most
        n[got["seed"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
        items.leave_out(n)
        yield items


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score): documents with a passage like a test item."""
    kinds = {k: t.schema[k].dataType.simpleString() for k, t in (("doc_id", docs), ("item_id", benchmark))}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, score double"

    def finder(items: Items):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = pa.array(items.ids)
            for b in C.pieces(batches):
                row, item, score = _matches(items, *_word_hashes(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), ids.take(pa.array(item)), pa.array(score)], ["doc_id", "item_id", "score"])

        return run

    parts = [docs.select("doc_id", "text").mapInArrow(finder(i), schema) for i in item_blocks(docs, benchmark) if i.ids]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without such a passage, with all their columns; no shuffle."""

    def clean(items: Items):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in C.pieces(batches):
                good = np.ones(b.num_rows, bool)
                good[_matches(items, *_word_hashes(b.column("text")))[0]] = False
                yield b.filter(pa.array(good))

        return run

    for items in item_blocks(docs, benchmark):
        docs = docs.mapInArrow(clean(items), docs.schema)
    return docs
