"""Other epoch loops than the field's: sampled descent from snapshots, bounded t-forces, and two phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldweave.functions.schedules import alpha, split_epochs
from fieldweave.operators import exact, graph
from fieldweave.operators.descent import asynchronous_layout
from fieldweave.operators.field import clip_norm
from fieldweave.operators.layout import FieldLayout, curve_parameters
from fieldweave.operators.saving import saved


def _moved(at: DataFrame, force: DataFrame, rate: float) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return at.join(force, "id", "left").select("id", (F.col("x") + rate * zero("fx")).alias("x"), (F.col("y") + rate * zero("fy")).alias("y"))


def sampled_epoch(due: DataFrame, at: DataFrame, numbered: DataFrame, n: int, seed: int, a: float, b: float, negatives: int = 5, gamma: float = 1.0, clip: float = 4.0) -> DataFrame:
    """Forces of one epoch on a snapshot: due edges pull both ends, hashed negatives push the source.

    numbered(place, id) holds 0 .. n - 1, so a negative is one equi-join.
    """
    cut = lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), v))
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    d2 = dx * dx + dy * dy
    pull = F.when(d2 > 0, -2 * a * b * F.pow(d2, b - 1) / (1 + a * F.pow(d2, b))).otherwise(0.0)
    pulled = exact._ends(due.select("src", "dst"), at).select("src", "dst", cut(pull * dx).alias("fx"), cut(pull * dy).alias("fy"))
    sides = pulled.select(F.explode(F.array(F.struct(F.col("src").alias("id"), "fx", "fy"), F.struct(F.col("dst").alias("id"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy")))).alias("e")).select("e.*")
    drawn = due.select("src", "dst", F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("k")).select("src", F.pmod(F.xxhash64("src", "dst", "k", F.lit(seed)), F.lit(n)).alias("place"))
    other = exact._ends(drawn.join(numbered, "place").select("src", F.col("id").alias("dst")).filter("src <> dst"), at)
    push = 2 * gamma * b / ((1e-3 + d2) * (1 + a * F.pow(d2, b)))
    pushed = other.select(F.col("src").alias("id"), cut(push * dx).alias("fx"), cut(push * dy).alias("fy"))
    return sides.union(pushed).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def sampled_layout(edges: DataFrame, init: DataFrame, n_epochs: int = 50, rate: float = 1.0, negatives: int = 5, seed: int = 0, spread: float = 1.0, min_dist: float = 0.2, save_every: int = 1) -> DataFrame:
    """Synchronous sampled descent from a prepared graph(src, dst, w) and positions."""
    a, b = curve_parameters(spread, min_dist)
    timed = saved(graph.intervals(graph.prune(edges, n_epochs), n_epochs))
    numbered = saved(_numbered(init))
    n, at = numbered.count(), saved(init.select("id", "x", "y"))
    for epoch in range(n_epochs):
        i = F.col("interval")
        due = timed.filter((F.lit(epoch) >= i) & (F.floor(F.lit(epoch) / i) > F.floor(F.lit(epoch - 1) / i)))
        at = _moved(at, sampled_epoch(due, at, numbered, n, seed + epoch, a, b, negatives), alpha(epoch, n_epochs, rate))
        if (epoch + 1) % save_every == 0 or epoch + 1 == n_epochs:
            at = saved(at)
    return at


def _numbered(rows: DataFrame) -> DataFrame:
    """(place, id) with places 0 .. n - 1: sizes of partitions are summed, then rows counted inside each."""
    dealt = saved(rows.select("id").repartition("id").withColumn("p", F.spark_partition_id()))
    sizes = {r.p: r.n for r in dealt.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    first = rows.sparkSession.createDataFrame(starts, "p int, start long")
    inside = F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1
    return dealt.withColumn("k", inside).join(F.broadcast(first), "p").select((F.col("start") + F.col("k")).alias("place"), "id")  # one row a partition


def t_layout(edges: DataFrame, init: DataFrame, n_epochs: int = 50, strength: float = 0.1, power: float = 2.0, beta: float = 8.0, momentum: float = 0.6, save_every: int = 1) -> DataFrame:
    """Bounded t-forces with momentum: attraction at the looked-ahead positions, steps of length 1 at most."""
    edges = saved(exact.edge_bias(edges))
    at = saved(init.select("id", "x", "y", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    for epoch in range(n_epochs):
        heat = 1 - epoch / n_epochs
        ahead = at.select("id", (F.col("x") + F.col("vx")).alias("x"), (F.col("y") + F.col("vy")).alias("y"))
        pull = exact.t_attraction(edges, ahead, beta).toDF("id", "ax", "ay")
        push = exact.t_repulsion(at.select("id", "x", "y"), power=power).toDF("id", "rx", "ry")
        both = at.join(pull, "id", "left").join(push, "id", "left")
        v = lambda c: momentum * F.col(f"v{c}") + heat * (strength * zero(f"a{c}") + zero(f"r{c}"))  # noqa: E731, B023
        step = clip_norm(both.select("id", v("x").alias("fx"), v("y").alias("fy")), 1.0)
        at = at.join(step, "id").select("id", (F.col("x") + F.col("fx")).alias("x"), (F.col("y") + F.col("fy")).alias("y"), F.col("fx").alias("vx"), F.col("fy").alias("vy"))
        if (epoch + 1) % save_every == 0 or epoch + 1 == n_epochs:
            at = saved(at)
    return at.select("id", "x", "y")


def two_phase_layout(points: DataFrame, n_epochs: int = 50, share: float = 0.3, asynchronous: bool = False, **settings) -> DataFrame:
    """Field epochs first, then sampled descent on the same graph for the given share of epochs.

    The second phase moves all points at once, or, where asynchronous, edge after edge.
    """
    first, second = split_epochs(n_epochs, share)
    model = FieldLayout(n_epochs=first, **settings)
    ready = model.prepare(points)
    at = model.optimize(ready["optimizer_graph"], ready["init"])
    loop = asynchronous_layout if asynchronous else sampled_layout
    return loop(ready["graph"], at, second, seed=model.seed, spread=model.spread, min_dist=model.min_dist)
