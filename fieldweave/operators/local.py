"""Exact repulsion near by: the k nearest others of a point in its own and the eight cells around, within a radius.

Points are packed by cell, crowded cells in several blocks, and blocks of neighbouring cells meet by an
equi-join, one row a pair of blocks: memory is bounded by the block, and a crowded cell spreads over tasks.
Only the k nearest of each pair of blocks leave the kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldweave.operators.field import cells
from fieldweave.operators.neighbors import BLOCK

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
NEAR = "src long, dst long, d2 double, dx double, dy double"


def occupancy(layout: DataFrame, boxes: int, around: bool = False) -> DataFrame:
    """(cx, cy, n) of occupied cells: the points in a cell, or in it and the eight around."""
    own = cells(layout, boxes).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    if not around:
        return own
    spread = own.select(F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in AROUND])).alias("c"), "n")
    total = spread.groupBy("c.cx", "c.cy").agg(F.sum("n").alias("n"))
    return total.join(own.select("cx", "cy"), ["cx", "cy"])


def density_threshold(layout: DataFrame, boxes: int, quantile: float) -> float:
    """Quantile (interpolated) of the points in occupied cells; infinite for an empty layout."""
    found = occupancy(layout, boxes).agg(F.percentile("n", quantile)).first()[0]
    return float("inf") if found is None else float(found)


def _packed(at: DataFrame) -> DataFrame:
    """(cx, cy, p): blocks of at most about BLOCK points of one cell."""
    size = at.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = at.join(size, ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return dealt.groupBy("cx", "cy", "part").agg(F.collect_list(F.struct("id", "x", "y")).alias("p")).drop("part")


def _kernel(k: int, radius: float, later: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ai, ax, ay), (bi, bx, by) = ([batch.column(c)[i].values.field(f).to_numpy() for f in ("id", "x", "y")] for c in ("own", "other"))
                dx, dy = ax[:, None] - bx[None, :], ay[:, None] - by[None, :]
                d2 = dx * dx + dy * dy
                out = (ai[:, None] == bi[None, :]) | (d2 <= 0) | (d2 > radius * radius)
                if later:
                    out |= bi[None, :] < ai[:, None]
                d2[out] = np.inf
                take = np.lexsort((np.broadcast_to(bi, d2.shape), d2), axis=1)[:, :k]
                best = np.take_along_axis(d2, take, 1)
                ok = np.isfinite(best).ravel()
                rows = (np.repeat(ai, take.shape[1]), bi[take].ravel(), best.ravel(), np.take_along_axis(dx, take, 1).ravel(), np.take_along_axis(dy, take, 1).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(r[ok]) for r in rows], ["src", "dst", "d2", "dx", "dy"])

    return kernel


def near_pairs(layout: DataFrame, boxes: int, k: int, radius: float, least: float | None = None, around: bool = False, symmetric: bool = False) -> DataFrame:
    """(src, dst, d2, dx, dy): up to k others of each point, nearest first (ties: smaller id), at a distance above 0 and up to the radius.

    ``least``: only points in cells with at least so many points have any, ``around`` counting the eight cells
    around too. ``symmetric``: only others of a greater id.
    """
    at = cells(layout, boxes).select("id", "x", "y", "cx", "cy")
    others = _packed(at).select(F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in AROUND])).alias("c"), F.col("p").alias("other"))
    if least is not None:
        at = at.join(occupancy(layout, boxes, around).filter(F.col("n") >= least).select("cx", "cy"), ["cx", "cy"])
    own = _packed(at.select("id", "x", "y", "cx", "cy")).withColumnRenamed("p", "own")
    pairs = own.join(others.select("c.cx", "c.cy", "other"), ["cx", "cy"]).select("own", "other").mapInArrow(_kernel(k, radius, symmetric), NEAR)
    order = Window.partitionBy("src").orderBy("d2", "dst")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def local_repulsion(
    layout: DataFrame, boxes: int, k: int, radius: float, alpha: float = 1.0, gamma: float = 1.0, a: float = 1.577, b: float = 0.895, eps: float = 1e-3, clip: float = 4.0, least: float | None = None, around: bool = False, symmetric: bool = False
) -> DataFrame:
    """(id, fx, fy) of points that have near pairs: each pair's push is clipped by component, then scaled by alpha.

    ``symmetric`` pushes both ends of a pair, in opposite directions.
    """
    pairs = near_pairs(layout, boxes, k, radius, least, around, symmetric)
    push = 2 * gamma * b / ((eps + F.col("d2")) * (1 + a * F.pow("d2", F.lit(b))))
    cut = lambda c: alpha * F.greatest(F.lit(-clip), F.least(F.lit(clip), push * F.col(c)))
    forces = pairs.select("src", "dst", cut("dx").alias("gx"), cut("dy").alias("gy"))
    out = forces.select(F.col("src").alias("id"), "gx", "gy")
    if symmetric:
        out = out.union(forces.select("dst", -F.col("gx"), -F.col("gy")))
    return out.groupBy("id").agg(F.sum("gx").alias("fx"), F.sum("gy").alias("fy"))
