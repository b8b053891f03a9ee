"""Exact and local forces of a layout(id, x, y), as the yardstick of the mesh and near dense places.

All pairs are evaluated by NumPy over pairs of blocks of positions, so memory is bounded by the
block; one row a vertex and task leaves the kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.field import cells
from fieldweave.operators.neighbors import TILE, _bytes, _slices, _vectors, block_pairs, wide_blocks
from fieldweave.operators.quantiles import quantile
from fieldweave.operators.saving import saved

FORCE = "id long, fx double, fy double"


def pairwise(layout: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], clip: float | None = None, weight: str | None = None, of: DataFrame | None = None) -> DataFrame:
    """Sum over others of kernel(d2) * (own - other); clipped by component and pair, then weighted by the other's column.

    ``of``: ids whose forces are wanted, else all. The pairs of one block follow each other in a task, which sums them.
    """
    third = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = layout.select("id", F.array(F.col("x"), F.col("y"), third).alias("features"))
    packed = wide_blocks(rows)
    own = packed if of is None else wide_blocks(rows.join(of.select("id").distinct(), "id", "left_semi"))
    pairs = block_pairs(own.toDF("a", "a_ids", "a_vectors"), packed.toDF("b", "b_ids", "b_vectors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            for i, a in enumerate(batch.column("a").to_pylist()):
                if a != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fx), pa.array(fy)], ["id", "fx", "fy"])
                    at, ids = a, _bytes(batch, "a_ids", i, np.int64).copy()
                    p = _vectors(batch, "a_vectors", i, len(ids)).T.copy()
                    fx, fy = np.zeros(len(ids)), np.zeros(len(ids))
                q = _vectors(batch, "b_vectors", i, len(batch.column("b_ids")[i].as_buffer()) // 8).T.copy()
                for mine in _slices(len(ids), TILE[0]):
                    for other in _slices(q.shape[1], TILE[1]):
                        dx, dy = (p[c, mine, None] - q[c, other] for c in (0, 1))
                        k = kernel(dx * dx + dy * dy)
                        dx *= k
                        dy *= k
                        if clip is not None:
                            np.clip(dx, -clip, clip, out=dx)
                            np.clip(dy, -clip, clip, out=dy)
                        fx[mine] += dx @ q[2, other]
                        fy[mine] += dy @ q[2, other]
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fx), pa.array(fy)], ["id", "fx", "fy"])

    return pairs.mapInArrow(run, FORCE).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def exact_repulsion(layout: DataFrame, gamma: float = 1.0, a: float = 1.577, b: float = 0.895, eps: float = 1e-3, clip: float = 4.0, weight: str | None = None, of: DataFrame | None = None) -> DataFrame:
    """Repulsion of all others, each pair clipped by component; on all points, or on those of(id)."""
    return pairwise(layout, lambda d2: 2 * gamma * b / ((eps + d2) * (1 + a * d2**b)), clip, weight, of)


def expected_repulsion(layout: DataFrame, edges: DataFrame, gamma: float = 1.0, a: float = 1.577, b: float = 0.895, eps: float = 1e-3, clip: float = 4.0) -> DataFrame:
    """Repulsion with the factor 1 - w on connected pairs: all pairs less the weighted share along edges."""
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    d2 = dx * dx + dy * dy
    k = 2 * gamma * b / ((eps + d2) * (1 + a * F.pow(d2, b)))
    cut = lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), v))
    along = _ends(edges, layout).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * cut(k * dx)).alias("ex"), F.sum(F.col("w") * cut(k * dy)).alias("ey"))
    return exact_repulsion(layout, gamma, a, b, eps, clip).join(along, "id", "left").select("id", (F.col("fx") - F.coalesce("ex", F.lit(0.0))).alias("fx"), (F.col("fy") - F.coalesce("ey", F.lit(0.0))).alias("fy"))


def _ends(edges: DataFrame, layout: DataFrame) -> DataFrame:
    s = layout.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    t = layout.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(s, "src").join(t, "dst")


def weighted_attraction(edges: DataFrame, layout: DataFrame, a: float = 1.577, b: float = 0.895, clip: float = 4.0) -> DataFrame:
    """Pull of every edge on its source, weighted before it is clipped by component."""
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    d2 = dx * dx + dy * dy
    g = F.when(d2 > 0, F.col("w") * -2 * a * b * F.pow(d2, b - 1) / (1 + a * F.pow(d2, b))).otherwise(0.0)
    cut = lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), v))
    return _ends(edges, layout).groupBy(F.col("src").alias("id")).agg(F.sum(cut(g * dx)).alias("fx"), F.sum(cut(g * dy)).alias("fy"))


def t_repulsion(layout: DataFrame, strength: float = 1.0, power: float = 2.0) -> DataFrame:
    """Bounded repulsion strength * d / (1 + d2) ** power of all others."""
    return pairwise(layout, lambda d2: strength / np.square(1 + d2) if power == 2 else strength * (1 + d2) ** -power)


def edge_bias(edges: DataFrame) -> DataFrame:
    """The target's share of both ends' out-degrees, for each edge."""
    n = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    both = edges.join(n.withColumnRenamed("n", "ns"), "src").join(n.select(F.col("src").alias("dst"), F.col("n").alias("nt")), "dst", "left")
    return both.select("src", "dst", "w", (F.coalesce("nt", F.lit(0)) / (F.col("ns") + F.coalesce("nt", F.lit(0)))).alias("bias"))


def t_attraction(edges: DataFrame, layout: DataFrame, beta: float = 8.0, most: float = 2000.0) -> DataFrame:
    """Pull (beta / (1 + d2) + bias) towards each edge's target, down to a greatest norm a vertex; bias 0 where absent."""
    biased = edges if "bias" in edges.columns else edges.withColumn("bias", F.lit(0.0))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    k = beta / (1 + dx * dx + dy * dy) + F.col("bias")
    summed = _ends(biased, layout).groupBy(F.col("src").alias("id")).agg(F.sum(k * dx).alias("fx"), F.sum(k * dy).alias("fy"))
    norm = F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2)
    cut = F.when(norm > most, most / norm).otherwise(1.0)
    return summed.select("id", (F.col("fx") * cut).alias("fx"), (F.col("fy") * cut).alias("fy"))


def density_pressure(layout: DataFrame, boxes: int, least: int, strength: float = 1.0) -> DataFrame:
    """Push away from the middle of a cell that holds more than ``least`` points, by its surplus."""
    at = cells(layout, boxes)
    full = at.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    push = strength * (F.col("n") - least) / F.col("n")
    middle = lambda c: F.col("low") + (F.col(c) + 0.5) * F.col("width")
    return at.join(full, ["cx", "cy"]).select("id", (push * (F.col("x") - middle("cx"))).alias("fx"), (push * (F.col("y") - middle("cy"))).alias("fy"))


def local_radius(edges: DataFrame, layout: DataFrame, factor: float = 1.0) -> DataFrame:
    """Factor times the median length of edges with one; null where there is none."""
    length = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)
    middle = quantile(saved(_ends(edges, layout).select(length.alias("d")).filter("d > 0")), "d", 0.5)
    return layout.sparkSession.createDataFrame([(None if middle is None else factor * middle,)], "radius double")


def add_noise(layout: DataFrame, scale: float, seed: int, fixed: DataFrame | None = None) -> DataFrame:
    """Gaussian noise from a hash of id and seed (the same on any partitioning); none on fixed ids."""
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    size = scale * F.sqrt(-2 * F.log(u(0)))
    free = F.lit(1.0)
    if fixed is not None:
        layout = layout.join(fixed.select("id", F.lit(True).alias("held")), "id", "left")
        free = F.when(F.col("held"), 0.0).otherwise(1.0)
    turn = 2 * np.pi * u(1)
    return layout.select("id", (F.col("x") + free * size * F.cos(turn)).alias("x"), (F.col("y") + free * size * F.sin(turn)).alias("y"))


def constrained(layout: DataFrame, known: DataFrame) -> DataFrame:
    """Positions with those of known(id, px, py) put in their place."""
    return layout.join(known, "id", "left").select("id", F.coalesce("px", "x").alias("x"), F.coalesce("py", "y").alias("y"))
