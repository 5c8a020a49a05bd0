"""Tables that cut lineage, in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary one only where unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="dirloom-"))
        atexit.register(shutil.rmtree, _own[0].removeprefix("file://"), ignore_errors=True)
    return _own[0]


def free_name(df: DataFrame, like: str) -> str:
    """A column name that ``df`` doesn't have, whatever its capitals."""
    taken = {c.lower() for c in df.columns}
    name = like
    while name.lower() in taken:
        name = "_" + name
    return name


#: Arrow batches of rows with texts, in bytes.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``.  Texts are of any length, so its session is told to cut Arrow batches at
    ``BATCH_BYTES`` (Spark's own limit is 64 MB), unless a lower limit is set there."""
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(_BATCHES))) > BATCH_BYTES:
        conf.set(_BATCHES, str(BATCH_BYTES))
    return df


class Scratch:
    """Parquet tables of one operator call: ``save`` writes and rereads a frame.

    A written table is read from replicated storage after an executor loss, and
    its lineage starts at the files.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[tuple[DataFrame, str]] = []
        small_batches(spark.range(0))

    def path(self, df: DataFrame, name: str = "t") -> str:
        """Where ``df`` has been written."""
        self.count += 1
        path = f"{self.base}/{self.count:02d}-{name}"
        df.write.parquet(path)
        return path

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(df, name)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((saved, path))
        return saved

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of tables that ``save`` returned."""
        sc = self.spark.sparkContext
        for df, at in [x for x in self.tables if any(x[0] is f for f in frames)]:
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            self.tables = [x for x in self.tables if x[0] is not df]

    def keep(self, *frames: DataFrame) -> None:
        """Delete the files of all tables but these."""
        self.drop(*(df for df, _ in self.tables if not any(df is f for f in frames)))

    def release(self) -> None:
        """Let Spark delete the shuffle files of frames that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


#: Ids that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def only_ids(frame: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    """``frame`` without most rows whose ``key`` isn't in ``ids`` (which has these columns),
    to spare the shuffle of a following join; all of it if the ids are too many."""
    if ids.count() > BROADCAST_ROWS:
        return frame
    return frame.join(F.broadcast(ids), key, "left_semi")


def without_ids(frame: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    """``frame`` without the rows whose ``key`` is in ``ids``."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return frame.join(ids, key, "left_anti")
