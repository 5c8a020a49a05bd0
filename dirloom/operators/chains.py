"""Lists whose pages name the next one, followed by doubling instead of page by page.

After round k a list's first 2 ** k pages are known; the next round joins them with the
table of steps of that length, and squares that table.  A list of n pages takes log2(n)
rounds of two joins.  A page that comes again (a list that leads back into itself) keeps
its first place, and a list that gains no page in a round is at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..materialize import cut


def chain_pages(links: DataFrame, starts: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """(key, page, pos) of the pages of each list, ``most`` at most.

    links: (page, next), null or absent at the end, of several the least; a next page counts
    only if it is in ``page`` itself (it was read).  starts: (key, start)."""
    steps = links.groupBy("page").agg(F.min("next").alias("next"))
    known = steps.select("page")
    jump = cut(steps.filter("next is not null").join(known.withColumnRenamed("page", "next"), "next", "left_semi").select("page", "next"))
    reached = cut(starts.join(known.withColumnRenamed("page", "start"), "start", "left_semi").select(key, F.col("start").alias("page"), F.lit(0).cast("long").alias("pos")).distinct())
    length, size = 1, reached.count()
    while size and (most is None or length < most):
        further = reached.join(jump, "page").select(key, F.col("next").alias("page"), (F.col("pos") + length).alias("pos"))
        both = reached.unionByName(further if most is None else further.filter(F.col("pos") < most))
        reached = cut(both.groupBy(key, "page").agg(F.min("pos").alias("pos")))
        now = reached.count()
        if now == size:
            break
        size = now
        jump = cut(jump.withColumnRenamed("next", "over").join(jump.withColumnRenamed("page", "over"), "over").select("page", "next"))
        length *= 2
    return reached.select(key, "page", "pos")
