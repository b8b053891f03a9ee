"""Spectral positions: leading eigenvectors of the normalised adjacency, of all components of a graph at once.

A round of the subspace iteration is a few products, each one join of the edges with the vectors and one sum by
vertex, and one aggregate by component: the small Gram matrix of the vectors. Matrices are turned into the next basis on the
workers, a row a component, so nothing is looped over components and only the count of those that still move
reaches the driver. Components are then placed by the affinity of their centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.connected import components
from fieldweave.operators.graph import _swapped
from fieldweave.operators.neighbors import knn
from fieldweave.operators.saving import saved

#: Vectors of the iteration, of which two are wanted (more settle sooner), and products between two aggregates.
VECTORS, STEPS = 8, 3
NAMES = [f"v{i}" for i in range(VECTORS)]
#: Components up to which their affinities form one small matrix (32 MB); beyond it, principal axes of the centroids.
AFFINITIES = 2048
#: Vertices up to which a component has hashed positions: it has too few eigenvectors.
FEW = 4


def _hashed(seed: int, k: int, low: float = -1.0, high: float = 1.0):
    """Uniform by a hash of the id: the same on any partitioning."""
    return low + (high - low) * F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53)


def _bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each component's turn: columns of t make the vectors, less o times the known one, orthonormal and sorted."""
    for batch in batches:
        if batch.num_rows:
            o = batch.column("o").flatten().to_numpy(zero_copy_only=False).reshape(-1, VECTORS)
            g = batch.column("g").flatten().to_numpy(zero_copy_only=False).reshape(-1, VECTORS, VECTORS) - o[:, :, None] * o[:, None, :]
            values, vectors = np.linalg.eigh((g + g.transpose(0, 2, 1)) / 2)
            values, vectors = values[:, ::-1], vectors[:, :, ::-1]
            real = values > 1e-14 * np.maximum(values[:, :1], 1e-300)
            t = np.where(real[:, None, :], vectors / np.sqrt(np.where(real, values, 1.0))[:, None, :], 0.0)
            listed = lambda x: pa.array(list(x.reshape(len(x), -1)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("o"), listed(t), listed(np.maximum(values[:, :2], 0) ** (0.5 / STEPS))], ["component", "o", "t", "top"])


def _turned(v: DataFrame) -> DataFrame:
    """(component, o, t, top): one aggregate over all vectors."""
    sums = v.groupBy("component").agg(F.array(*[F.sum(F.col("q") * F.col(n)) for n in NAMES]).alias("o"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in NAMES for b in NAMES]).alias("g"))
    return sums.mapInArrow(_bases, "component long, o array<double>, t array<double>, top array<double>")


def _applied(v: DataFrame, turn: DataFrame) -> DataFrame:
    """The vectors of every component in its new basis."""
    free = lambda i: F.col(NAMES[i]) - F.col("o")[i] * F.col("q")
    column = lambda j: sum((free(i) * F.col("t")[i * VECTORS + j] for i in range(1, VECTORS)), free(0) * F.col("t")[j])
    return v.join(turn, "component").select("id", "component", "q", *[column(j).alias(NAMES[j]) for j in range(VECTORS)])


def spectral_layouts(at: DataFrame, edges: DataFrame, rounds: int = 8, seed: int = 0, tolerance: float = 1e-7) -> DataFrame:
    """(id, component, x, y) for at(id, component): each component's second and third eigenvectors of D^-1/2 A D^-1/2.

    The first one, sqrt of the degrees, is known and projected out. Axes are reflected so that their mean lies at
    or below the middle of their range. Vertices without edges have no row.
    """
    both = edges.select("src", "dst", "w").union(_swapped(edges)).groupBy("src", "dst").agg(F.max("w").alias("w")).filter("src <> dst AND w > 0")
    degree = saved(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree")).join(at, "id"))
    total = degree.groupBy("component").agg(F.sum("degree").alias("total"))
    d1, d2 = degree.select(F.col("id").alias("src"), F.col("degree").alias("ds")), degree.select(F.col("id").alias("dst"), F.col("degree").alias("dt"))
    # (A + I) / 2 has no negative eigenvalue, so the leading ones are the wanted ones
    half = both.join(d1, "src").join(d2, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dt")) / 2).alias("w"))
    a = saved(half.union(degree.select("id", "id", F.lit(0.5))))
    v = saved(degree.join(total, "component").select("id", "component", F.sqrt(F.col("degree") / F.col("total")).alias("q"), *(_hashed(seed, k).alias(n) for k, n in enumerate(NAMES))))
    last = None
    for turn in range(rounds + 1):
        bases = saved(_turned(v))
        v = _applied(v, bases)
        if last is not None:
            # the Gram matrix after a round holds the eigenvalues of its products, squared
            gap = F.greatest(*[F.abs(F.col("top")[i] - F.col("before")[i]) for i in (0, 1)])
            moving = bases.join(last, "component").filter(gap >= tolerance).limit(1).count()
            if not moving or turn == rounds:
                break
        last = bases.select("component", F.col("top").alias("before"))
        known, x = v.select("id", "component", "q"), v.select("id", *NAMES)
        for _ in range(STEPS):
            x = a.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in NAMES))
        v = saved(x.join(known, "id").select("id", "component", "q", *NAMES))
    v = saved(v.select("id", "component", F.col("v0").alias("x"), F.col("v1").alias("y")))
    s = v.groupBy("component").agg(*(f(c).alias(n + c) for c in "xy" for f, n in ((F.avg, "m"), (F.min, "l"), (F.max, "h"))))
    mirror = lambda c: F.when(F.col("m" + c) > (F.col("l" + c) + F.col("h" + c)) / 2, -F.col(c)).otherwise(F.col(c)).alias(c)
    return v.join(s, "component").select("id", "component", mirror("x"), mirror("y"))


def spectral_layout(vertices: DataFrame, edges: DataFrame, rounds: int = 8, seed: int = 0, tolerance: float = 1e-7) -> DataFrame:
    """(id, x, y) of one connected graph edges(src, dst, w); vertices without edges are placed at 0."""
    found = spectral_layouts(vertices.select("id", F.lit(0).cast("long").alias("component")), edges, rounds, seed, tolerance)
    return vertices.select("id").join(found.drop("component"), "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def reflected(layout: DataFrame) -> DataFrame:
    """Each axis mirrored where its mean lies above the middle of its range."""
    s = layout.agg(*(f(c).alias(n + c) for c in "xy" for f, n in ((F.avg, "m"), (F.min, "l"), (F.max, "h"))))
    turn = lambda c: F.when(F.col("m" + c) > (F.col("l" + c) + F.col("h" + c)) / 2, -F.col(c)).otherwise(F.col(c)).alias(c)
    return layout.crossJoin(F.broadcast(s)).select("id", turn("x"), turn("y"))  # one row


def scaled(layout: DataFrame, high: float = 10.0) -> DataFrame:
    """Each axis onto 0 .. high; an axis without extent to 0."""
    s = layout.agg(*(f(c).alias(n + c) for c in "xy" for f, n in ((F.min, "l"), (F.max, "h"))))
    to = lambda c: F.when(F.col("h" + c) > F.col("l" + c), high * (F.col(c) - F.col("l" + c)) / (F.col("h" + c) - F.col("l" + c))).otherwise(0.0).alias(c)
    return layout.crossJoin(F.broadcast(s)).select("id", to("x"), to("y"))  # one row


def compacted(layout: DataFrame, most: float = 10.0, jitter: float = 1e-4, seed: int = 0) -> DataFrame:
    """Centred and shrunk (never grown) by one factor to a greatest span, with hashed jitter relative to it."""
    s = layout.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53) - 0.5
    f = F.when(F.col("span") > most, most / F.col("span")).otherwise(1.0)
    to = lambda c, k: (f * (F.col(c) - F.col("m" + c)) + 2 * jitter * f * F.col("span") * u(k)).alias(c)
    return layout.crossJoin(F.broadcast(s)).select("id", to("x", 0), to("y", 1))  # one row


def centroid_layout(at: DataFrame, points: DataFrame | None, seed: int = 0) -> DataFrame:
    """(component, mx, my, reach): a place for every component and half the way to the nearest other one.

    Up to four components lie on the axes. More are laid out by the affinities exp(-d^2) of their centroids:
    the second and third eigenvectors of the random walk on them (one small matrix up to AFFINITIES components,
    the two principal axes of the centroids beyond), or by hash where no points are given.
    """
    spark = at.sparkSession
    n = at.select("component").distinct().count()
    if n <= 4:
        half = -(-n // 2)
        ring = [(1.0, 0.0), (0.0, 1.0)][:half] + [(-1.0, 0.0), (0.0, -1.0)][:half]
        rows = [(r.component, *ring[i]) for i, r in enumerate(at.select("component").distinct().orderBy("component").collect())]
        places = spark.createDataFrame(rows, "id long, x double, y double")
    elif points is None:
        places = at.select(F.col("component").alias("id")).distinct().select("id", _hashed(seed, 0, 0, 10).alias("x"), _hashed(seed, 1, 0, 10).alias("y"))
    else:
        f = points.select("id", F.posexplode(F.col("features").cast("array<double>")).alias("axis", "value"))
        means = saved(f.join(at, "id").groupBy("component", "axis").agg(F.avg("value").alias("value")))
        places = _by_affinity(means) if n <= AFFINITIES else _by_axes(means)
    near = knn(places.select("id", F.array("x", "y").alias("features")), 1).select(F.col("src").alias("id"), (F.col("dist") / 2).alias("reach")) if n > 1 else None
    placed = places.join(near, "id", "left") if near is not None else places.withColumn("reach", F.lit(1.0))
    # places that coincide, or components without a centroid, still get some room
    return at.select(F.col("component").alias("id")).distinct().join(placed, "id", "left").select(
        F.col("id").alias("component"), F.coalesce("x", F.lit(0.0)).alias("mx"), F.coalesce("y", F.lit(0.0)).alias("my"), F.when(F.col("reach") > 0, F.col("reach")).otherwise(1e-3).alias("reach")
    )


def _by_affinity(means: DataFrame) -> DataFrame:
    rows = means.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("axis", "value"))).alias("c")).select("component", F.col("c.value").alias("c")).orderBy("component").collect()
    x = np.array([r.c for r in rows])  # at most AFFINITIES centroids
    affinity = np.exp(-np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T, 0))
    root = np.sqrt(affinity.sum(1))
    _, vectors = np.linalg.eigh(affinity / np.outer(root, root))
    place = vectors[:, [-2, -3]] / root[:, None]
    place *= np.where(place[np.abs(place).argmax(0), [0, 1]] < 0, -1, 1)  # signs don't depend on the solver
    place /= max(np.abs(place).max(), 1e-300)
    return means.sparkSession.createDataFrame([(r.component, float(a), float(b)) for r, (a, b) in zip(rows, place, strict=True)], "id long, x double, y double")


def _by_axes(means: DataFrame) -> DataFrame:
    """Principal axes of the centroids: the leading left vectors of the centred table."""
    from fieldweave.operators.svd import truncated_svd

    middle = means.groupBy("axis").agg(F.avg("value").alias("middle"))
    centred = means.join(F.broadcast(middle), "axis").select(F.col("component").alias("row"), F.col("axis").cast("long").alias("col"), (F.col("value") - F.col("middle")).alias("value"))  # a row an axis
    features, s, _ = truncated_svd(centred, 2)
    scale = 1 / s[0] if s else 1.0
    return features.select(F.col("row").alias("id"), (F.col("features")[0] * scale).alias("x"), F.coalesce(F.get("features", F.lit(1)) * scale, F.lit(0.0)).alias("y"))


def spectral_init(vertices: DataFrame, edges: DataFrame, points: DataFrame | None = None, seed: int = 0, **settings) -> DataFrame:
    """Spectral positions of a graph of any number of components: each around its own place, within its reach.

    Components of at most FEW vertices, vertices without edges and components without a finite extent have hashed
    positions there. ``points`` (id, features) place the components by their centroids.
    """
    at = saved(components(vertices, edges))
    if at.select("component").distinct().limit(2).count() < 2:
        return spectral_layout(vertices, edges, seed=seed, **settings)
    own = spectral_layouts(at, edges, seed=seed, **settings)
    size = own.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.max(F.abs("x")), F.max(F.abs("y"))).alias("extent"))
    size = size.filter(f"n > {FEW} AND extent > 0")
    shaped = own.join(size, "component").select("id", (F.col("x") / F.col("extent")).alias("x"), (F.col("y") / F.col("extent")).alias("y"))
    place = centroid_layout(at, points, seed)
    out = at.join(shaped, "id", "left").select("id", "component", F.coalesce("x", _hashed(seed, 10)).alias("x"), F.coalesce("y", _hashed(seed, 11)).alias("y"))
    return out.join(place, "component").select("id", (F.col("mx") + F.col("reach") * F.col("x")).alias("x"), (F.col("my") + F.col("reach") * F.col("y")).alias("y"))
