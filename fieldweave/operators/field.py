"""Forces of a two-dimensional layout: attraction along edges, repulsion exact or by mesh moments."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.quantiles import kth, quantile
from fieldweave.operators.saving import saved


def bounds(layout: DataFrame) -> DataFrame:
    """Least and greatest coordinate of each axis, the joint span and non-finite rows; layout(id, x, y)."""
    return layout.agg(
        *(f(c).alias(n) for c in ("x", "y") for f, n in ((F.min, f"min_{c}"), (F.max, f"max_{c}"))),
        (F.greatest(F.max("x"), F.max("y")) - F.least(F.min("x"), F.min("y"))).alias("span"),
        F.count_if(F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))).alias("n_bad"),
    )


def cells(layout: DataFrame, boxes: int) -> DataFrame:
    """Each point's cell; both axes share the least coordinate and the width, which is 1 where there is no extent."""
    span = F.greatest(F.max("x"), F.max("y")) - F.least(F.min("x"), F.min("y"))
    b = layout.agg(F.least(F.min("x"), F.min("y")).alias("low"), F.when(span > 0, span / boxes).otherwise(1.0).alias("width"))
    cell = lambda c: F.least(F.floor((F.col(c) - F.col("low")) / F.col("width")), F.lit(boxes - 1)).cast("int")
    return layout.crossJoin(F.broadcast(b)).select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"), "low", "width")


def moments(layout: DataFrame, boxes: int) -> DataFrame:
    """Sums and counts of each occupied cell."""
    return cells(layout, boxes).groupBy("cx", "cy").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("cnt"))


def mesh_repulsion(layout: DataFrame, boxes: int, gamma: float = 1.0, a: float = 1.577, b: float = 0.895, eps: float = 1e-3, clip: float = 4.0) -> DataFrame:
    """Repulsion from cell moments: kernel by cell offset, force phi * y - psi.

    Cells are at most boxes ** 2, so the cell-by-cell join does not grow with the points.
    """
    at = cells(layout, boxes)
    m = at.groupBy("cx", "cy", "width").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("cnt"))
    other = m.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), "sx", "sy", "cnt")
    dx, dy = (F.col("cx") - F.col("ox")) * F.col("width"), (F.col("cy") - F.col("oy")) * F.col("width")
    d2 = dx * dx + dy * dy
    kernel = F.least(F.lit(clip), 2 * gamma * b / ((eps + d2) * (1 + a * F.pow(d2, b))))
    field = m.select("cx", "cy", "width").crossJoin(other).withColumn("k", kernel).groupBy("cx", "cy").agg(F.sum(F.col("k") * F.col("cnt")).alias("phi"), F.sum(F.col("k") * F.col("sx")).alias("px"), F.sum(F.col("k") * F.col("sy")).alias("py"))
    return at.join(F.broadcast(field) if boxes <= 256 else field, ["cx", "cy"]).select("id", (F.col("phi") * F.col("x") - F.col("px")).alias("fx"), (F.col("phi") * F.col("y") - F.col("py")).alias("fy"))


def attraction(edges: DataFrame, layout: DataFrame, a: float = 1.577, b: float = 0.895, clip: float = 4.0) -> DataFrame:
    """Pull of each edge on its source row only, clipped by component before summing."""
    s = layout.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    t = layout.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    d2 = dx * dx + dy * dy
    g = F.when(d2 > 0, -2 * a * b * F.pow(d2, b - 1) / (1 + a * F.pow(d2, b))).otherwise(0.0)
    cut = lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), v))
    pulled = edges.join(s, "src").join(t, "dst").withColumns({"gx": cut(g * dx), "gy": cut(g * dy)})
    return pulled.groupBy(F.col("src").alias("id")).agg(F.sum("gx").alias("fx"), F.sum("gy").alias("fy"))


def clip_norm(forces: DataFrame, most: float) -> DataFrame:
    """Scale force vectors down to a greatest norm."""
    norm = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
    scale = F.when(norm > most, most / norm).otherwise(1.0)
    return forces.select("id", (F.col("fx") * scale).alias("fx"), (F.col("fy") * scale).alias("fy"))


def clip_total(pull: DataFrame, push: DataFrame, most: float) -> DataFrame:
    """(id, ax, ay, rx, ry, norm): both forces scaled by one factor so that their sum has a greatest norm; norm is that before."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = pull.toDF("id", "ax", "ay").join(push.toDF("id", "rx", "ry"), "id", "full").select("id", *(zero(c).alias(c) for c in ("ax", "ay", "rx", "ry")))
    norm = F.sqrt((F.col("ax") + F.col("rx")) ** 2 + (F.col("ay") + F.col("ry")) ** 2)
    scale = F.least(F.lit(1.0), most / (norm + 1e-12))
    return both.select("id", *((F.col(c) * scale).alias(c) for c in ("ax", "ay", "rx", "ry")), norm.alias("norm"))


def step(layout: DataFrame, edges: DataFrame, boxes: int, alpha: float, clip: float = 4.0) -> DataFrame:
    """One epoch: attraction plus mesh repulsion clipped by vector, times alpha."""
    pull = attraction(edges, layout)
    push = clip_norm(mesh_repulsion(layout, boxes), clip)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, q = pull.toDF("id", "ax", "ay"), push.toDF("id", "rx", "ry")
    both = layout.join(p, "id", "left").join(q, "id", "left")
    return both.select("id", (F.col("x") + alpha * (zero(F.col("ax")) + zero(F.col("rx")))).alias("x"), (F.col("y") + alpha * (zero(F.col("ay")) + zero(F.col("ry")))).alias("y"))


def core_shape(layout: DataFrame, share: float = 0.99, far: float = 2.0) -> DataFrame:
    """Bounding boxes of all points and of the core, the share nearest the median, and the points far outside it.

    The core radius is the distance of rank ceil(share * n), an exact percentile; of points at that very
    distance all belong to the core.
    """
    mx, my = (F.lit(quantile(layout, c, 0.5)).cast("double") for c in "xy")
    at = saved(layout.select("x", "y", F.sqrt((F.col("x") - mx) ** 2 + (F.col("y") - my) ** 2).alias("r")))
    n = at.count()
    edge = kth(at, "r", max(ceil(share * n), 1) - 1) if n else None
    both = at.withColumn("core_radius", F.lit(edge).cast("double"))
    inside = F.col("r") <= F.col("core_radius")
    side = lambda c, pick: F.max(pick(c)) - F.min(pick(c))
    every, core = (lambda c: F.col(c)), (lambda c: F.when(inside, F.col(c)))
    found = both.agg(
        side("x", every).alias("width"), side("y", every).alias("height"), side("x", core).alias("core_width"), side("y", core).alias("core_height"),
        F.first("core_radius").alias("core_radius"), F.max("r").alias("radius_max"), F.count_if(F.col("r") > far * F.col("core_radius")).alias("far_count"), F.count(F.lit(1)).alias("n"),
    )
    area, core_area = F.col("width") * F.col("height"), F.col("core_width") * F.col("core_height")
    return found.select("*", F.try_divide(area, core_area).alias("area_ratio"), F.greatest(F.try_divide("width", "core_width"), F.try_divide("height", "core_height")).alias("extent_ratio"), (100.0 * F.col("far_count") / F.col("n")).alias("far_pct"))
