"""Where to judge an approximate field: ranked target groups, and errors by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.neighbors import knn
from fieldweave.operators.quantiles import quantile

#: The neighbour, itself counted, whose distance tells how dense a place is.
DENSE_RANK = 8
SMALLEST = 2.220446049250313e-16


def select_targets(layout: DataFrame, edges: DataFrame, random_count: int, stress_count: int, seed: int = 0, near: DataFrame | None = None) -> DataFrame:
    """(target_group, place, id): a hashed sample, the greatest degrees, the densest places and those farthest out.

    A group has as many rows as asked for, or as there are points; ties go to the smaller id, places start at 0.
    The middle is the median of each axis, a degree the sum of weights from a vertex, density the distance to the
    eighth neighbour, the point itself counted (the last one where there are fewer). ``near`` may bring neighbour
    rows (src, rank, dist) from elsewhere. No points give no rows.
    """
    mid = [quantile(layout, c, 0.5) or 0.0 for c in "xy"]
    out = F.sqrt((F.col("x") - mid[0]) ** 2 + (F.col("y") - mid[1]) ** 2)
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))
    if near is None:
        near = knn(layout.select("id", F.array("x", "y").alias("features")), DENSE_RANK - 1)
    reach = near.filter(F.col("rank") < DENSE_RANK).groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("reach"))
    ids = layout.select("id")
    ranked = {
        "random": (ids.select("id", F.md5(F.concat_ws(":", F.lit(seed), "id")).alias("key")), random_count),
        "high_degree": (ids.join(degrees, "id", "left").select("id", (-F.coalesce("degree", F.lit(0.0))).alias("key")), stress_count),
        "dense_region": (ids.join(reach, "id", "left").select("id", F.coalesce("reach", F.lit(0.0)).alias("key")), stress_count),
        "radial_tail": (layout.select("id", (-out).alias("key")), stress_count),
    }
    groups = []
    for name, (rows, most) in ranked.items():
        top = rows.orderBy("key", "id").limit(most)  # partial top-k in every task; a group has the size asked for
        packed = top.agg(F.array_sort(F.collect_list(F.struct("key", "id"))).alias("all"))
        groups.append(packed.select(F.lit(name).alias("target_group"), F.posexplode("all.id").alias("place", "id")))
    first, *rest = groups
    for group in rest:
        first = first.union(group)
    return first


def error_rows(exact: DataFrame, approximate: DataFrame, targets: DataFrame, floor_ratio: float = 1e-3) -> DataFrame:
    """Errors of approximate(id, fx, fy) against exact(id, fx, fy), one row a target group.

    Relative errors are over the exact norm, or over a floor where that is less: the ratio of the median norm of
    all targets. Angles count where both norms exceed the floor. A target without a force has the force 0.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    wanted = targets.select("id").distinct()
    both = wanted.join(exact.toDF("id", "ex", "ey"), "id", "left").join(approximate.toDF("id", "ax", "ay"), "id", "left")
    both = both.select("id", *(zero(c).alias(c) for c in ("ex", "ey", "ax", "ay")))
    length = lambda a, b: F.sqrt(a * a + b * b)
    c = F.col
    both = both.withColumns({"norm": length(c("ex"), c("ey")), "other": length(c("ax"), c("ay")), "gap": length(c("ax") - c("ex"), c("ay") - c("ey"))})
    floor = max((quantile(both, "norm", 0.5) or 0.0) * floor_ratio, SMALLEST)
    under = F.greatest("norm", F.lit(floor))
    cosine = (c("ex") * c("ax") + c("ey") * c("ay")) / F.greatest(c("norm") * c("other"), F.lit(floor * floor))
    judged = both.select("id", "norm", "gap", (c("gap") / under).alias("relative"), (F.abs(c("other") - c("norm")) / under).alias("by_norm"), ((c("norm") > floor) & (c("other") > floor)).alias("valid"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).alias("angle"))
    middle, p95 = (lambda x: F.percentile(x, 0.5)), (lambda x: F.percentile(x, 0.95))  # of a group, whose size is given
    angle = F.when(c("valid"), c("angle"))
    return targets.join(judged, "id").groupBy("target_group").agg(
        F.count(F.lit(1)).alias("n_targets"),
        middle("gap").alias("absolute_error_median"),
        middle("relative").alias("relative_error_median"),
        p95("relative").alias("relative_error_p95"),
        F.max("relative").alias("relative_error_max"),
        middle("by_norm").alias("norm_error_median"),
        middle(angle).alias("angle_median_deg"),
        p95(angle).alias("angle_p95_deg"),
        F.count(F.when(c("valid"), 1)).alias("n_valid_angles"),
        F.count(F.when(c("norm") <= floor, 1)).alias("n_near_zero"),
        F.lit(floor).alias("floor"),
    )
