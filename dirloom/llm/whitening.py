"""Whitened embeddings: principal axes of distinct vectors through distributed block matrices.

``Whitening.fit`` learns from the distinct vectors of a table, ``transform`` projects
every row.  Entries are made whole numbers first (``lattice``), so sums are exact and
each vector is centred as (n * x - S) / n, with one rounding, before anything is
multiplied:

* centred rows get gapless numbers and become an MLlib ``BlockMatrix``;
* its transpose times itself, cut over the long side so that no task meets all of it,
  is the scatter matrix, of dims * dims numbers: the only thing that reaches the driver;
* ``numpy.linalg.eigh`` there gives the axes, and a second block multiplication, by the
  axes over the roots of their variances, projects the rows.

The covariance of the projected distinct vectors is multiplied out in the same way to
tell how far it is from the identity.  MLlib's driver keeps a coordinate for every block
(``BLOCK_ROWS`` rows at most each).

Edge cases: a null vector and one with a null, NaN or infinite entry is left out.  Where
lengths differ, those of the commonest length stay (of equal ones the greater).  An empty
table, or one without usable vectors, gives an empty result.  An axis without variance
(one vector, constant or dependent entries) has whitened 0 and doesn't count in
identity_error; explained is 0 on all axes if nothing varies.  Rows with equal ids and
equal vectors each keep their row.  deviation is null where it exceeds a long; entries
so large that n * x itself does are an error, not a wrong number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch, free_name

COMPONENTS = 16
#: Steps of a unit, and what is added to each entry.
STEPS, OFFSET = 64, 1_000_000
#: Rows of a block at most, blocks of a matrix that are tried for, and cuts of its long side.
BLOCK_ROWS, BLOCKS, SPLITS = 1 << 14, 256, 256
#: Columns of a block at most.
BLOCK_COLS = 1024
#: Share of the greatest variance below which an axis counts as constant.
NO_VARIANCE = 1e-12


def lattice(vector: Column) -> Column:
    """Whole numbers floor(STEPS * c) + OFFSET of the entries."""
    return F.transform(vector, lambda c: F.floor(F.lit(STEPS) * c.cast("double")) + OFFSET)


def usable(vector: Column) -> Column:
    """Not null, not empty, and only finite entries."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: finite(c.cast("double"))), F.lit(False))


def numbered(df: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """``df`` written with a gapless long column ``name`` from 0 on."""
    part, pos = free_name(df, "part"), free_name(df, "pos")
    saved = scratch.save(df.withColumns({part: F.spark_partition_id(), pos: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = saved.groupBy(part).count().collect()  # one row a partition
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r[part]):
        starts.append((r[part], total))
        total += r["count"]
    base = free_name(saved, "base")
    first = df.sparkSession.createDataFrame(starts, f"{part} int, {base} long")
    return saved.join(F.broadcast(first), part).withColumn(name, F.col(base) + F.col(pos)).drop(part, pos, base)


#: A block as Spark ML writes it; MLlib reads the same file with its own type.
_BLOCK = "struct<type: tinyint, numRows: int, numCols: int, colPtrs: array<int>, rowIndices: array<int>, values: array<double>, isTransposed: boolean>"
_PLACED = T.StructType([T.StructField("at", T.StructType([T.StructField("r", T.LongType()), T.StructField("c", T.LongType())])), T.StructField("block", MatrixUDT())])


def block_matrix(rows: DataFrame, index: str, values: str, n: int, dims: int, scratch: Scratch) -> BlockMatrix:
    """Rows (index from 0 to n - 1, array of dims doubles) as distributed blocks, written once:
    MLlib goes over them several times a multiplication, and a lost one is read again."""
    tall, wide = min(BLOCK_ROWS, max(1, -(-n // BLOCKS))), min(BLOCK_COLS, dims)
    part = F.slice(values, F.col("c") * wide + 1, wide)
    cut = rows.select(F.floor(F.col(index) / tall).alias("r"), F.col(index).alias("i"), values, F.explode(F.sequence(F.lit(0), F.lit((dims - 1) // wide))).alias("c"))
    held = cut.groupBy("r", "c").agg(F.sort_array(F.collect_list(F.struct("i", part.alias("v")))).alias("held"))  # ``tall`` rows
    flat = F.flatten(F.transform("held", lambda h: h["v"]))
    none = F.lit(None).cast("array<int>")
    block = F.struct(F.lit(1), F.size("held"), F.size(F.get("held", 0)["v"]), none, none, flat, F.lit(True)).cast(_BLOCK)
    path = scratch.path(held.select(F.struct("r", F.col("c").cast("long").alias("c")).alias("at"), block.alias("block")), "blocks")
    blocks = rows.sparkSession.read.schema(_PLACED).parquet(path)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, tall, wide, n, dims), tall, wide)


def block_rows(matrix: BlockMatrix, index: str, values: str) -> DataFrame:
    """A block matrix as rows (index, array of doubles)."""
    found = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias(index), vector_to_array("vector").alias(values))


def gram(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, on the driver.  The Python form of ``multiply`` can't cut
    the long side, without which one task would meet all blocks, so MLlib's own is called."""
    model = matrix._java_matrix_wrapper._java_model
    product = model.transpose().multiply(model, min(SPLITS, matrix.numRowBlocks))
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


@dataclass
class Whitening:
    """Of ``n`` distinct vectors: their sums, and the axes by falling variance."""

    n: int
    sums: list[int]
    axes: np.ndarray  # dims x components, unit columns
    variance: np.ndarray
    explained: np.ndarray
    index: str
    values: str

    @classmethod
    def fit(cls, distinct: DataFrame, index: str, values: str, scratch: Scratch, components: int = COMPONENTS) -> Whitening | None:
        """From distinct arrays of longs with gapless numbers; None if there are none."""
        dims = distinct.select(F.size(values).alias("d")).first()
        if dims is None:
            return None
        dims = dims["d"]
        total = distinct.select(F.posexplode(values).alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
        sums, n = [int(r["s"]) for r in sorted(total, key=lambda r: r["k"])], total[0]["n"]
        made = cls(n, sums, np.zeros((dims, 0)), np.zeros(0), np.zeros(0), index, values)
        scatter = gram(block_matrix(made.centred(distinct), index, "centred", n, dims, scratch))
        value, vector = np.linalg.eigh((scatter + scatter.T) / (2 * n))
        order = np.argsort(-value, kind="stable")[: min(components, dims)]
        made.axes, made.variance = vector[:, order], np.maximum(value[order], 0)
        trace = np.trace(scatter) / n
        made.explained = made.variance / trace if trace > 0 else np.zeros(len(order))
        return made

    def _sums(self) -> Column:
        return F.lit(self.sums).cast("array<long>")

    def centred(self, df: DataFrame) -> DataFrame:
        """``index`` and centred: x - S / n, from whole numbers."""
        n = F.lit(self.n).cast("long")
        return df.select(self.index, F.zip_with(self.values, self._sums(), lambda x, s: (x * n - s).cast("double") / n).alias("centred"))

    def deviation(self) -> Column:
        """Sum of (n * x - S) ** 2, exact."""
        apart = F.zip_with(self.values, self._sums(), lambda x, s: x * F.lit(self.n).cast("long") - s)
        fits = F.array_max(F.transform(apart, lambda d: F.abs(d))) <= int((2**62 / len(self.sums)) ** 0.5)
        fast = F.reduce(apart, F.lit(0).cast("long"), lambda acc, d: acc + d * d)
        wide = F.reduce(apart, F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"))
        return F.when(fits, fast).otherwise(wide.try_cast("long"))

    def varies(self) -> np.ndarray:
        return self.variance > NO_VARIANCE * max(self.variance.max(initial=0), 1e-300)

    def transform(self, rows: DataFrame, count: int, scratch: Scratch) -> DataFrame:
        """``index`` and whitened (an array, a number a component) of numbered rows."""
        scale = np.where(self.varies(), 1 / np.sqrt(np.where(self.varies(), self.variance, 1)), 0)
        matrix = block_matrix(self.centred(rows), self.index, "centred", count, len(self.sums), scratch)
        by, wide = self.axes * scale, matrix.colsPerBlock
        cut = [((k, 0), DenseMatrix(len(p), by.shape[1], p.ravel(order="F").tolist())) for k, p in enumerate(np.split(by, range(wide, len(by), wide)))]
        projection = BlockMatrix(rows.sparkSession.sparkContext.parallelize(cut), wide, by.shape[1], *by.shape)
        return block_rows(matrix.multiply(projection), self.index, "whitened")

    def identity_error(self, whitened: DataFrame, scratch: Scratch) -> float:
        """Greatest absolute entry of the covariance of the n whitened vectors (whose
        ``index`` is gapless) minus the identity, over the axes that vary."""
        keep = np.flatnonzero(self.varies())
        if not len(keep):
            return 0.0
        c = gram(block_matrix(whitened, self.index, "whitened", self.n, self.axes.shape[1], scratch)) / self.n
        return float(np.abs(c[np.ix_(keep, keep)] - np.eye(len(keep))).max())


_EMPTY = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening_report(spark: SparkSession, embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each usable row and component: key, component (from 1 on), n, deviation,
    whitened, explained and identity_error."""
    scratch = Scratch(spark, "whitening")
    rows = embeddings.filter(usable(F.col(vector))).select(F.col(key).alias("key"), lattice(F.col(vector)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], f"key {embeddings.schema[key].dataType.simpleString()}, {_EMPTY}").withColumnRenamed("key", key)
    rows = numbered(rows.filter(F.size("x") == lengths["d"]), "row", scratch)
    # each distinct vector once, with the row that stands for it
    distinct = numbered(rows.groupBy("x").agg(F.min("row").alias("first")), "item", scratch)
    model = Whitening.fit(distinct, "item", "x", scratch, components)
    model_rows = Whitening(**{**vars(model), "index": "row"})
    projected = scratch.save(model_rows.transform(rows, lengths["count"], scratch), "projected")
    fitted = distinct.select("first", "item").join(projected.withColumnRenamed("row", "first"), "first").select("item", "whitened")
    error = model.identity_error(fitted, scratch)
    per = F.posexplode(F.zip_with("whitened", F.lit(model.explained.tolist()), lambda w, e: F.struct(w.alias("whitened"), e.alias("explained")))).alias("at", "of")
    found = rows.select("row", "key", model_rows.deviation().alias("deviation")).join(projected, "row").select("key", "deviation", per)
    return found.select(
        F.col("key").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("of.whitened").alias("whitened"),
        F.col("of.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
