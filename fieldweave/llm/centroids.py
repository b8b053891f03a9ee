"""Centroid clustering on exact integers, screened in float32.

Each component x becomes floor(64 x). A batch of vectors meets all centroids in one float32 matrix
product; for every pair a rigorous bound of its rounding error turns the product into an interval of
the squared distance. Centroids whose interval starts above the lowest upper end can't be nearest.
Where more than one is left, their distances are computed again in exact integers, ties going to the
smaller number. Centroids move to the exact floor of the mean of their vectors: batches add their
components up as integers, in limbs of 60 bits, and Spark adds the limbs. So the result depends on
neither the partitions nor the order of the rows.

Only the centroids (a fixed number, one vector each) pass through the driver. Vectors are read once
a round and never shuffled; one shuffled row holds one component's sum of one task.

Kept are vectors of exactly ``DIM`` components, none null, NaN or infinite; others, and null vectors,
have no row in the result. Repeated rows are vectors of their own, each with its row. A null id is kept
(null in the result) and chosen as a first centroid only after all others; rows of one id are chosen in
the order of their components. With fewer vectors than centroids there are fewer centroids; an empty
table gives no rows. Components of any finite size are exact; a distance or an inertia that exceeds 64
bits is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import checkpointed

DIM, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Bits of a limb: sums of so many bits over 2**64 rows fit a decimal of 38 digits.
LIMB = 60
LONG = (1 << 63) - 1


def kept(embeddings: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, x): the vectors of ``dim`` finite components, as doubles."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.filter((F.size("embedding") == dim) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers, or Python's (an object array) where a component is too large for them."""
    if not len(x) or np.abs(x).max() < 2.0**56:
        return np.floor(x * SCALE).astype(np.int64)  # SCALE is a power of two: the product is exact
    exact = [[int(c) * SCALE if abs(c) >= 2.0**53 else math.floor(c * SCALE) for c in row] for row in x.tolist()]
    return np.array(exact, dtype=object)


def exact_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, row by row; Python's integers where 64 bits might not do."""
    safe = 1 << ((62 - v.shape[1].bit_length()) // 2 - 1)  # gaps of twice that, squared and summed, stay below 2**62
    small = v.dtype != object and c.dtype != object and max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= safe
    gap = v - c if small else v.astype(object) - c.astype(object)
    return (gap * gap).sum(axis=1)


def _floats(v: np.ndarray) -> np.ndarray:
    """As doubles; integers beyond their range are infinite, so that their intervals are the whole line."""
    if v.dtype != object:
        return v.astype(np.float64)
    return np.array([[float(x) if abs(x) < 1 << 1000 else math.inf for x in row] for row in v]).reshape(v.shape)


def intervals(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |c|^2 - 2 v.c, which orders the centroids of a vector as the distance does.

    The product is in float32. Rounding both inputs and summing n products, in any order and with fused
    steps or without, errs by at most g |v|.|c| with g = (n + 2) u / (1 - (n + 2) u), u = 2**-24; the
    absolute dot product is at most the product of the norms (Cauchy-Schwarz). The float64 steps around it
    are covered by 2**-40 of the same quantities. Integers can't underflow; what overflows gets the whole line.
    """
    wide_v, wide_c = _floats(v), _floats(c)
    with np.errstate(over="ignore", invalid="ignore"):
        dot = (wide_v.astype(np.float32) @ wide_c.astype(np.float32).T).astype(np.float64)
        norm_c2 = (wide_c * wide_c).sum(1)
        reach = np.sqrt((wide_v * wide_v).sum(1))[:, None] * np.sqrt(norm_c2)[None, :]
        n, u = v.shape[1] + 2, 2.0**-24
        middle = norm_c2[None, :] - 2 * dot
        radius = 2 * reach * (n * u / (1 - n * u)) * (1 + 2.0**-40) + 2.0**-40 * (norm_c2[None, :] + 2 * reach)
        low, high = middle - radius, middle + radius
    unsure = ~(np.isfinite(low) & np.isfinite(high))
    low[unsure], high[unsure] = -np.inf, np.inf
    return low, high


def nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row; of equally near ones the smallest."""
    low, high = intervals(v, c)
    listed = low <= high.min(axis=1)[:, None]
    found = listed.argmax(axis=1)
    unsure = np.flatnonzero(listed.sum(axis=1) > 1)
    if len(unsure):
        row, number = np.nonzero(listed[unsure])
        exact = exact_distances(v[unsure][row], c[number])
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(exact, starts)
        first = np.where(exact == np.repeat(least, np.diff(np.r_[starts, len(row)])), number, len(c))
        found[unsure] = np.minimum.reduceat(first, starts)
    return found


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, rest, k = (1 if value >= 0 else -1), abs(value), 0
    while rest:
        yield k, sign * (rest & ((1 << LIMB) - 1))
        rest >>= LIMB
        k += 1


def _batches(batches: Iterator[pa.RecordBatch], dim: int):
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield batch, quantised(x)


def _integers(rows: list[list[int]]) -> np.ndarray:
    large = any(abs(x) >= 1 << 62 for row in rows for x in row)
    return np.array(rows, dtype=object if large else np.int64)


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every vector to its nearest centroid, every centroid with vectors to the floor of their mean."""
    dim = len(centroids[0])

    def sums(batches):
        c = _integers(centroids)
        total, count = [[0] * dim for _ in c], [0] * len(c)
        for _, v in _batches(batches, dim):
            number = nearest(v, c)
            # in parts of so few rows that a sum fits 64 bits
            step = max(1, LONG // max(1, int(np.abs(v).max()))) if v.dtype != object else len(v)
            for k in np.unique(number):
                mine = v[number == k]
                for at in range(0, len(mine), step):
                    total[k] = [a + int(b) for a, b in zip(total[k], mine[at : at + step].sum(axis=0), strict=True)]
                count[k] += len(mine)
        rows = [(k, -1, 0, count[k]) for k in range(len(c)) if count[k]]
        rows += [(k, j, limb, part) for k in range(len(c)) for j in range(dim) for limb, part in _limbs(total[k][j])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["k", "j", "limb", "part"])

    parts = vectors.mapInArrow(sums, "k long, j long, limb long, part long")
    added = parts.groupBy("k", "j", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()  # centroids x components x limbs
    count, total = [0] * len(centroids), [[0] * dim for _ in centroids]
    for r in added:
        if r.j < 0:
            count[r.k] = int(r.s)
        else:
            total[r.k][r.j] += int(r.s) << (LIMB * r.limb)
    return [[t // n for t in total[k]] if (n := count[k]) else centroids[k] for k in range(len(centroids))]


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every vector and the exact squared distance to it."""
    dim = len(centroids[0])

    def rows(batches):
        c = _integers(centroids)
        for batch, v in _batches(batches, dim):
            number = nearest(v, c)
            far = [int(d) if d <= LONG else None for d in exact_distances(v, c[number])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(rows, "vec_id long, cluster int, distance long")


def seeds(vectors: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """The k vectors of the smallest sha256 of ``1:<vec_id>``, in that order."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.select("x", digest.alias("digest")).orderBy(F.col("digest").asc_nulls_last(), "x").limit(k).collect()
    return [[int(c) for c in quantised(np.array([r.x]))[0]] for r in chosen]


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """Every kept vector with its cluster, distance, inertias and the digest of its final centroid."""
    spark = embeddings.sparkSession
    vectors = kept(embeddings, dim)
    centroids = seeds(vectors, k)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = checkpointed(assigned(vectors, centroids))
    # a null distance (above 64 bits) makes the sums null
    whole = lambda c: F.when(F.count(F.lit(1)) == F.count(c), F.sum(F.col(c).cast("decimal(38,0)")))
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(whole("distance").alias("s")).collect()}  # a row a centroid
    fits = lambda s: int(s) if s is not None and s <= LONG else None
    all_known = None not in sums.values()
    inertia = fits(sum(sums.values())) if all_known else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = spark.createDataFrame([(n, fits(s), inertia, digest(centroids[n])) for n, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """All rounds written out, with lists as vectors."""
    near = lambda at, c: (
        f"{at} AS (SELECT r, vec_id, e, k, d FROM (SELECT r, vec_id, e, k, list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, {c}) "
        "QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"
    )
    steps = []
    for i in range(ROUNDS):
        steps += [
            near(f"a{i}", f"c{i}"),
            f"m{i} AS (SELECT k, list(f ORDER BY j) AS c FROM (SELECT k, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS f FROM (SELECT k, unnest(e) AS x, unnest(range({DIM})) AS j FROM a{i}) GROUP BY k, j) GROUP BY k)",
            f"c{i + 1} AS (SELECT k, coalesce(m.c, p.c) AS c FROM c{i} p LEFT JOIN m{i} m USING (k))",
        ]
    return rf"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS k, e AS c FROM v QUALIFY k < {CENTROIDS}),
{", ".join(steps)},
{near("a", f"c{ROUNDS}")}
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN c{ROUNDS} c ON a.k = c.k"""


ORACLE = {"op12_centroid_clustering": _sql()}
