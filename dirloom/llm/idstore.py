"""Token-id store: ids of documents in binary frames, ordered by doc_id.

Documents are range-partitioned by id and sorted; each partition is encoded as a
stream into frames of about ``FRAME_IDS`` ids (whole documents, so a longer one
makes a longer frame), each a row of a Parquet table in shared storage:

    part, frame    place in the order
    start          ids before the frame in its part
    docs           doc_id and number of ids of each document
    payload        the ids, as ``coder.encode_frame`` writes them

Blocks inside a payload are coded independently and checked by CRC32.  Reading
needs the ids before each part: one row a part reaches the driver.

Edge cases: null and empty texts have only the end id; null doc_ids sort first;
rows of equal doc_id are ordered by text; very long documents stay whole; an
empty table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columnar as C
from .bytebpe import byte_encoder
from .coder import decode_frame, encode_frame
from .storage import small_batches

FRAME_IDS = 2_000_000
END_ID = 0

_DOCS = pa.struct([("doc_id", pa.int64()), ("n", pa.int64())])
STORE = "part int, frame int, start long, n long, docs array<struct<doc_id: long, n: long>>, payload binary"


def _frames(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = byte_encoder(path)
        names, counts, parts = [], [], []  # of the open frame
        held = frame = start = 0

        def flush() -> pa.RecordBatch:
            ids, sizes = np.concatenate(parts), np.concatenate(counts)
            docs = pa.StructArray.from_arrays([pa.concat_arrays(names), pa.array(sizes)], fields=list(_DOCS))
            rows = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), docs)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([start]), pa.array([len(ids)]), rows, pa.array([encode_frame(ids)], pa.binary())], ["part", "frame", "start", "n", "docs", "payload"])

        for b in C.pieces(batches):
            ids, at = encoder.encode(b.column("text"))
            n = np.diff(at) + 1
            ends = np.cumsum(n) - 1
            with_end = np.empty(ends[-1] + 1, np.int32)
            mine = np.ones(len(with_end), bool)
            mine[ends] = False
            with_end[mine], with_end[ends] = ids, end_id
            names.append(b.column("doc_id"))
            counts.append(n)
            parts.append(with_end)
            held += len(with_end)
            if held >= FRAME_IDS:
                yield flush()
                frame, start = frame + 1, start + held
                names, counts, parts, held = [], [], [], 0
        if names:
            yield flush()

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Write the store of all documents to ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    small_batches(ordered).mapInArrow(_frames(tokenizer_path, end_id), STORE).write.parquet(path)


def _documents(before: dict[int, int], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1)
                ids = decode_frame(b.column("payload")[0].as_py())
                docs = b.column("docs").flatten()
                n = docs.field("n").to_numpy()
                at = np.concatenate([[0], np.cumsum(n)])
                base = before[b.column("part")[0].as_py()] + b.column("start")[0].as_py()
                if len(ids) != at[-1]:
                    raise ValueError("a frame holds another number of ids than its documents")
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
                else:
                    last = C.list_array(ids, n, pa.int32())
                yield pa.RecordBatch.from_arrays([docs.field("doc_id"), pa.array(base + at[:-1]), pa.array(n), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or their ids_crc32) of each stored document."""
    store = spark.read.parquet(path)
    before, total = {}, 0
    for r in store.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        before[r["part"]] = total
        total += r["n"]
    last = "ids_crc32 long" if digest else "ids array<int>"
    frames = store.select("part", "start", "docs", "payload")
    return frames.mapInArrow(_documents(before, digest), f"doc_id long, start long, n_tokens long, {last}")
