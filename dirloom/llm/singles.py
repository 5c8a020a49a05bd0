"""How many elements of each set no other set holds: the inverted lists of one entry.

A set with many such elements can link with nothing, so this strikes most sets
out before any list is built.  All lists are counted, but packed: an element is
32 bits of its hash beside 32 bits of its set's signature, and a task sends one
blob of sorted elements to each bucket of the hash space.  A bucket holds whole
lists; where the first and the last set of a list are the same, the element is
alone, and its set's signature goes on to a second exchange that counts by set.

Two elements with equal 32 bits in one bucket only make an element look shared;
sets with equal 32 bits are told apart by ``alone``, which claims nothing for
them.  So the counts never exceed the truth.  Equal sets (copies) count as one.

Memory: a bucket has ``ELEMENTS`` entries on the average at most (``LEAST`` where
that leaves tasks idle) at any input size, as the number of buckets grows with it; a frequent element sends two entries a task at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as C
from .shingles import shingle_sets, signatures

ELEMENTS, LEAST = 1 << 20, 1 << 15
_FLUSH = 1 << 20
_U = np.uint64
_LOW = _U(0xFFFFFFFF)


def _edges(key: np.ndarray) -> np.ndarray:
    """Which elements begin a run; False for none."""
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return first


def _blobs(bucket: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A row of values for each bucket; ``bucket`` ascends."""
    at = np.flatnonzero(_edges(bucket))
    end = np.append(at[1:], len(bucket))
    blobs = [values[i:j].tobytes() for i, j in zip(at, end, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _elements(n: int, share: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            bucket, entry = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((entry, bucket))
            bucket, entry = bucket[order], entry[order]
            first = _edges(entry >> _U(32)) | _edges(bucket)
            outer = first.copy()  # of each list the first and the last are enough
            outer[:-1] |= first[1:]
            outer[-1:] = True
            return _blobs(bucket[outer], entry[outer])

        held, size = [], 0
        for b in C.pieces(batches):
            h, at = shingle_sets(b.column("text"), n)
            own = (signatures(h, at)[0].view(np.uint64) & _LOW)[C.rows_of(at)]
            mine = (h & _U(share - 1)) == 0
            h, own = h[mine], own[mine]
            held.append((((h & _LOW) >> _U(8)) % _U(buckets), (h & ~_LOW) | own))
            size += len(h)
            if size > _FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[np.ndarray]:
    """The values of each bucket; rows are sorted by bucket."""
    held: list[bytes] = []
    bucket = None
    for b in batches:
        for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob"), strict=True):
            if held and k != bucket:
                yield np.frombuffer(b"".join(held), kind)
                held = []
            bucket = k
            held.append(blob.as_buffer().to_pybytes())
    if held:
        yield np.frombuffer(b"".join(held), kind)


def _alone(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            own = np.concatenate(held)
            bucket = own % np.uint32(buckets)
            order = np.argsort(bucket, kind="stable")
            return _blobs(bucket[order], own[order])

        held, size = [], 0
        for entry in _grouped(batches, np.uint64):
            entry = np.sort(entry)
            first = np.flatnonzero(_edges(entry >> _U(32)))
            last = np.append(first[1:], len(entry)) - 1
            own = (entry[first[entry[first] == entry[last]]] & _LOW).astype(np.uint32)
            held.append(own)
            size += len(own)
            if size > _FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in _grouped(batches, np.uint32):
        mark, n = np.unique(own, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(mark.astype(np.int64)), pa.array(n)], ["mark", "alone"])


def mark(signature: str):  # noqa: ANN201
    """The 32 bits of a signature by which sets are counted."""
    return F.col(signature).bitwiseAND(F.lit(0xFFFFFFFF))


def alone(docs: DataFrame, sets: DataFrame, n: int, elements: int, share: int = 1) -> DataFrame:
    """``sets`` (with the signature s1) with a column ``alone``: how many of the set's
    elements no other text of ``docs`` has, at least.  Only one element in ``share``
    (a power of two) is looked at; ``elements`` tells about how many all texts have."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    looked_at = elements // share
    buckets = 1 + max(min(partitions, looked_at // LEAST), looked_at // ELEMENTS)
    blobs = "bucket long, blob binary"
    sent = docs.select("text").mapInArrow(_elements(n, share, buckets), blobs)
    lists = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(C.released(_alone(buckets)), blobs)
    counted = lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(C.released(_count), "mark long, alone long")
    marked = sets.withColumn("mark", mark("s1"))
    known = marked.groupBy("mark").agg(F.count("*").alias("c")).filter("c = 1").drop("c").join(counted, "mark")
    return marked.join(known, "mark", "left").drop("mark").withColumn("alone", F.coalesce("alone", F.lit(0)))
