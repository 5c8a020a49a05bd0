"""Sharding by sampled splitters: shards of near equal bytes (law ``bytes``).

Records are ordered by a hash of their text, then by id.  A size-weighted
sample (the records with the least -ln(u)/size, u a hash of the record) is
drawn, its quantiles split the order into ranges of about equal bytes, and
ranges that turn out overfull are subdivided by a further sample from inside
them.  Exact totals of the ranges then place every record in the whole order:
its byte offset decides its shard, its rank its slot.  The sample only decides
how evenly the work is spread.

Equal texts are neighbours in the order and go to one shard.  Groups of over
1/``LARGE`` of a shard (single long texts, too) are placed first, the largest
first, each in the emptiest shard; the bounds of the shards in the order of the
others then fill all shards to one level.  So sizes differ by about 1/``LARGE``
of a shard.  Only a group larger than a shard is divided, where the bounds fall,
as no law of equal sizes could keep it whole.

What reaches the driver: a sample of ``SAMPLES`` rows a range, one row a range
(of ``RANGE_ROWS`` records, so a few thousand for a billion records) and at most
``LARGE`` * shards large groups.  Only ids, sizes and hashes are shuffled, never
texts.  Randomness is a hash of the data, so recomputed tasks draw the same
sample.

Edge cases: null texts have size 8 and count as empty; null ids sort first;
repeated rows are records of their own; a text larger than a shard makes its
shard larger; an empty table gives an empty result; further columns are ignored;
doc_id must be an integer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch

SHARDS = 24
#: Ranges for each shard at least, records of a range, sample records of a range.
RANGES = 4
RANGE_ROWS = 2_000_000
SAMPLES = 64
OVERFULL = 2.0
LARGE = 200
OVERHEAD = 8
_LEAST = -(1 << 63)

Splitters = list[tuple[int, int]]


def _range_of(splitters: Splitters):
    keys, idents = (np.array(x, np.int64) for x in zip(*splitters, strict=True)) if splitters else (np.zeros(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy()
            ident = b.column("ident").to_numpy()
            out, end = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            for lo in np.unique(out[end > out]).tolist():  # keys that are split themselves
                mine = np.flatnonzero((out == lo) & (end > lo))
                out[mine] += np.searchsorted(idents[lo : end[mine[0]]], ident[mine], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "range"])

    return run


def _sample(records: DataFrame, n: int) -> pd.DataFrame:
    """The n records of a size-weighted sample, fewer if there are fewer, in order."""
    u = (F.pmod(F.xxhash64("key", "ident", F.lit(17)), F.lit(1 << 40)) + 1) / F.lit((1 << 40) + 1)
    fields = [c for c in ("key", "ident", "range") if c in records.columns]
    drawn = records.select(*fields, (-F.log(u) / F.col("size")).alias("p")).orderBy("p", "key", "ident").limit(n)
    return drawn.toPandas().sort_values(["key", "ident"])


def _quantiles(drawn: pd.DataFrame, parts: int) -> Splitters:
    """Bounds of ``parts`` parts; at the start of a group unless it has several."""
    out: Splitters = []
    for k in range(1, parts if len(drawn) else 0):
        key, ident = (int(drawn[c].iloc[k * len(drawn) // parts]) for c in ("key", "ident"))
        out.append((key, ident) if out and out[-1][0] == key else (key, _LEAST))
    return out


def _levelled(large: list[tuple[int, int]], total: int, shards: int) -> tuple[dict[int, int], list[int]]:
    """(shard of each large group, bounds of the shards in the bytes of the others)."""
    held = [(0, s) for s in range(shards)]
    shard = {}
    for size, key in sorted(large, reverse=True):
        have, s = heapq.heappop(held)
        shard[key] = s
        heapq.heappush(held, (have + size, s))
    have = [b for b, _ in sorted(held, key=lambda x: x[1])]
    rest = total - sum(have)
    # The level to which ``rest`` fills the shards, as a fraction.
    low = sorted(have)
    n = next(n for n in range(1, shards + 1) if n == shards or rest + sum(low[:n]) <= n * low[n])
    level, over = divmod(rest + sum(low[:n]), n)
    bounds, at, seen = [0], 0, 0
    for b in have:
        if b <= level:
            at += level - b
            seen += over
        bounds.append(at + seen // n)
    return shard, bounds


def _deal(base: dict[int, tuple[int, int, int]], bounds: list[int], most: float):
    """Rows sorted by (range, key, ident): shard and rank of each, as a stream.

    ``base``: bytes and rows before each range, and the shard of one that is part of a large group, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = 2 * np.array(bounds[1:-1], np.int64)
        held: list[pa.RecordBatch] = []  # rows of the group that is open
        at = [None, 0, 0]  # range, bytes and rows given out in it
        large = None  # the group that is divided

        def place(rows: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None]:
            nonlocal large
            rng, key, size = (rows.column(c).to_numpy() for c in ("range", "key", "size"))
            edge = np.ones(len(rng), bool)
            edge[1:] = (rng[1:] != rng[:-1]) | (key[1:] != key[:-1])
            begin = np.flatnonzero(edge)
            end = np.append(begin[1:], len(rng))
            sums = np.add.reduceat(size, begin)
            whole = sums <= most
            if large == (rng[0], key[0]):
                whole[0] = False
            left = None
            if not last and whole[-1]:
                left = rows.slice(int(begin[-1]))
                rows, rng, key, size = rows.slice(0, int(begin[-1])), rng[: begin[-1]], key[: begin[-1]], size[: begin[-1]]
                begin, end, sums, whole = begin[:-1], end[:-1], sums[:-1], whole[:-1]
            if not len(rng):
                return None, left
            large = None if whole[-1] else (rng[-1], key[-1])
            first = np.ones(len(rng), bool)
            first[1:] = rng[1:] != rng[:-1]
            starts = np.flatnonzero(first)
            of = np.cumsum(first) - 1
            before = np.cumsum(size) - size
            mine = np.array([base[int(r)] for r in rng[starts]], np.int64).reshape(-1, 3)
            if at[0] == rng[0]:
                mine[0, :2] += at[1:]
            offset = before - before[starts][of] + mine[of, 0]
            rank = np.arange(len(rng)) - starts[of] + mine[of, 1]
            group = np.cumsum(edge[: len(rng)]) - 1
            middle = np.where(whole[group], 2 * offset[begin][group] + sums[group], 2 * offset + size)
            fixed = mine[of, 2]
            shard = np.where(fixed >= 0, fixed, np.searchsorted(edges, middle, "right"))
            r0, b0 = int(rng[-1]), base[int(rng[-1])]
            at[:] = [r0, int(offset[-1] + size[-1]) - b0[0], int(rank[-1]) + 1 - b0[1]]
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("size"), rows.column("text_crc32"), pa.array(shard), pa.array(rank), pa.array(np.where(fixed >= 0, key, 0), mask=fixed < 0)], ["doc_id", "size", "text_crc32", "shard", "rank", "large"]), left

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0] if held else b
            out, left = place(rows, False)
            held = [left] if left is not None else []
            if out is not None:
                yield out
        if held:
            out, _ = place(held[0], True)
            if out is not None:
                yield out

    return run


def shard_by_bytes(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every row."""
    scratch = Scratch(spark, "sharding")
    text = F.coalesce("text", F.lit(""))
    kind = docs.schema["doc_id"].dataType
    records = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("ident"),
    )
    records = scratch.save(records, "records")
    schema = "doc_id long, size long, text_crc32 long, key long, ident long, range long"
    total, rows = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    most, fair = total / shards / LARGE, total / shards
    groups = records.groupBy("key").agg(F.sum("size").alias("b")).filter((F.col("b") > most) & (F.col("b") <= fair))
    large = [(r["b"], r["key"]) for r in groups.collect()]  # LARGE * shards at most
    shard, bounds = _levelled(large, total, shards)
    ranges = max(shards * RANGES, rows // RANGE_ROWS)
    own = {(k + d, _LEAST) for k in shard for d in (0, 1) if k + d < 1 << 63}
    splitters = sorted({*_quantiles(_sample(records, ranges * SAMPLES), ranges), *own})
    while True:
        ranged = records.mapInArrow(_range_of(splitters), schema)
        totals = {r["range"]: (r["b"], r["c"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("c")).collect()}
        over = [r for r, (b, c) in totals.items() if b * ranges > OVERFULL * total and c > 1]
        if not over:
            break
        drawn = _sample(ranged.filter(F.col("range").isin(over)), ranges * SAMPLES)
        more = set(splitters)
        for r in over:
            more |= set(_quantiles(drawn[drawn["range"] == r], int(totals[r][0] * ranges / total) + 1))
        if len(more) == len(splitters):
            break
        splitters = sorted(more)
    base, before = {}, {}
    for r in sorted(totals):
        key = splitters[r - 1][0] if r else None
        group = key if key in shard else None
        b, c = before.get(group, (0, 0))
        base[r] = (b, c, shard.get(group, -1))
        before[group] = (b + totals[r][0], c + totals[r][1])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS)
    dealt = ranged.repartitionByRange(max(min(len(totals), tasks), 1), "range").sortWithinPartitions("range", "key", "ident", "text_crc32")
    placed = dealt.mapInArrow(_deal(base, bounds, most), "doc_id long, size long, text_crc32 long, shard long, rank long, large long")
    placed = scratch.save(placed, "placed")
    scratch.keep(placed)
    parts = placed.groupBy("shard", "large").agg(F.min("rank").alias("first"), F.count("*").alias("n"))  # a row a shard and large group
    earlier = Window.partitionBy("shard").orderBy(F.col("large").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    start = parts.select(F.col("shard").alias("of"), F.col("large").alias("of_large"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("start"))
    same = (F.col("shard") == F.col("of")) & F.col("large").eqNullSafe(F.col("of_large"))
    return placed.join(F.broadcast(start), same).select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") + F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
