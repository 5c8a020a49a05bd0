"""Connected components of an edge table, by alternating star operations.

Large-star links every larger neighbour of a node to its smallest neighbour,
small-star does the same for the smaller ones; the edges end as stars around
the smallest node of each component after a number of rounds that grows with
the logarithm of its size.  Every round is two aggregations and joins on node
ids, with partial aggregation before each shuffle, and is cut by a written
table.  Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(neighbours: DataFrame, larger: bool) -> DataFrame:
    """neighbours: (u, v); links each v beyond u (or all, and u) to the least of u's."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = neighbours.join(least, "u")
    if larger:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def components(edges: DataFrame, scratch: Scratch, rounds: int | None = None) -> DataFrame:
    """edges: (u long, v long).  Returns (u, root): each node that has an edge, but
    for the roots themselves, with the smallest id of its component.

    After a given number of ``rounds`` the result is edges of the same components, with
    mostly the smallest ids in ``root``; a node may come several times."""
    now = scratch.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, done = None, 0
    while True:
        large = scratch.save(_star(_both(now), True).filter("u <> v").distinct(), "large")
        following = scratch.save(_star(large, False).filter("u <> v").distinct(), "small")
        scratch.drop(now, large)
        now, done = following, done + 1
        if done == rounds:
            return now.select("u", F.col("v").alias("root"))
        if rounds is None:
            r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
            if mark == (r["n"], r["s"]):
                return now.select("u", F.col("v").alias("root"))
            mark = (r["n"], r["s"])
