"""Neighbour graphs: symmetric closures, fuzzy weights, pruning, degrees and sampling calendars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.quantiles import quantile
from fieldweave.operators.saving import saved


def _swapped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def symmetric_min(edges: DataFrame) -> DataFrame:
    """Least weight over both directions of each edge."""
    return edges.select("src", "dst", "w").union(_swapped(edges)).groupBy("src", "dst").agg(F.min("w").alias("w"))


def symmetric_max(edges: DataFrame) -> DataFrame:
    """Elementwise maximum with the transpose; absent is 0, and zeros vanish."""
    both = edges.select("src", "dst", "w").union(_swapped(edges)).groupBy("src", "dst").agg(F.max("w").alias("w"))
    return both.filter("w > 0")


def fuzzy_weights(neighbours: DataFrame, mix: float = 1.0, rounds: int = 64) -> DataFrame:
    """Fuzzy union of smoothed neighbour weights: bandwidth by bisection inside each row's array."""
    rows = neighbours.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("n"))
    ds = F.transform("n", lambda x: x["dist"])
    rho = F.coalesce(F.array_min(F.filter(ds, lambda d: d > 0)), F.lit(0.0))
    k = F.size("n") + 1
    rows = rows.select("src", "n", ds.alias("d"), rho.alias("rho"), F.log2(k.cast("double")).alias("goal"))
    mass = lambda s: F.aggregate("d", F.lit(0.0), lambda t, d: t + F.exp(-F.greatest(F.lit(0.0), d - F.col("rho")) / s))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(math.inf).alias("hi"), F.lit(1.0).alias("mid"))

    def halve(x, _):
        high = mass(x["mid"]) > F.col("goal")
        lo, hi = F.when(high, x["lo"]).otherwise(x["mid"]), F.when(high, x["mid"]).otherwise(x["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(hi == math.inf, x["mid"] * 2).otherwise((lo + hi) / 2).alias("mid"))

    rows = rows.withColumn("sigma", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)["mid"])
    directed = rows.select("src", "rho", "sigma", F.explode("n").alias("e")).select("src", F.col("e.dst").alias("dst"), F.exp(-F.greatest(F.lit(0.0), F.col("e.dist") - F.col("rho")) / F.col("sigma")).alias("w"))
    both = directed.withColumn("v", F.lit(0.0)).union(directed.select("dst", "src", F.lit(0.0), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"), F.sum("v").alias("v"))
    product = F.col("w") * F.col("v")
    return both.select("src", "dst", (mix * (F.col("w") + F.col("v") - product) + (1 - mix) * product).alias("w"))


def prune(edges: DataFrame, n_epochs: int) -> DataFrame:
    """Drop edges whose weight is below the greatest over the epochs."""
    top = edges.agg(F.max("w").alias("top"))
    return edges.crossJoin(F.broadcast(top)).filter(F.col("w") >= F.col("top") / n_epochs).drop("top")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Weighted degree of every vertex, 0 for isolated ones."""
    summed = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))
    return vertices.select("id").join(summed, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def damping(degree: DataFrame, q: float = 0.99, power: float = 0.5, floor: float = 0.0) -> DataFrame:
    """Scale (reference / degree) ** power capped at 1; isolated vertices keep 1."""
    degree = saved(degree)
    ref = quantile(degree, "degree", q)
    scale = F.when(F.col("degree") > 0, F.greatest(F.lit(floor), F.least(F.lit(1.0), F.pow(F.lit(ref) / F.col("degree"), power)))).otherwise(1.0)
    return degree.select("id", "degree", scale.alias("scale"))


def intervals(edges: DataFrame, n_epochs: int) -> DataFrame:
    """Epochs between draws of an edge: greatest weight over its own; -1 where it is never drawn."""
    top = edges.agg(F.max("w").alias("top"))
    draws = n_epochs * F.col("w") / F.col("top")
    return edges.crossJoin(F.broadcast(top)).withColumn("interval", F.when(draws > 0, n_epochs / draws).otherwise(-1.0)).drop("top")


def calendar(edges: DataFrame, n_epochs: int) -> DataFrame:
    """(epoch, src, dst): an edge is due at the first whole epochs not before its repeated intervals."""
    timed = intervals(edges, n_epochs).filter("interval > 0")
    counted = timed.withColumn("n", F.floor(F.lit(n_epochs - 1) / F.col("interval")))
    events = counted.filter("n >= 1").select("src", "dst", "interval", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    return events.select(F.ceil(F.col("i") * F.col("interval")).cast("int").alias("epoch"), "src", "dst").filter(F.col("epoch") < n_epochs).distinct()
