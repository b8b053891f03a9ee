"""Connected components by alternating large-star and small-star steps.

Only joins, minima and distinct are used: no neighbour list is gathered, hot vertices are summed before they
are shuffled, and the rounds grow with the logarithm of the vertices, not with the graph's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.saving import saved


def _mark(edges: DataFrame) -> tuple[int, str]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, str(row.h)


def components(vertices: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex: the smallest id reachable along edges(src, dst) in any direction."""
    ordered = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
    pairs = saved(ordered.distinct())
    mark = _mark(pairs)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        pairs = saved(small.select("e.a", "e.b").filter("a <> b").distinct())
        before, mark = mark, _mark(pairs)
        if before == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return vertices.select("id").join(pairs.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
