"""Embedding quality: neighbourhood, rank, triplet, distance and label-agreement measures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldweave.operators.neighbors import knn, nearer_counts, pair_distances_by_block
from fieldweave.operators.pair_ranks import correlation_of_pairs
from fieldweave.operators.saving import saved


def _near(points: DataFrame, k: int, known: DataFrame | None) -> DataFrame:
    """The k nearest of every point, from a table of at least as many where one is known."""
    return knn(points, k) if known is None else known.filter(F.col("rank") <= k)


def neighborhood_preservation(source: DataFrame, embedding: DataFrame, k: int = 15, source_near: DataFrame | None = None, embedded_near: DataFrame | None = None) -> DataFrame:
    """Share of source neighbours kept in the embedding: per point and its mean."""
    shared = _near(source, k, source_near).join(_near(embedding, k, embedded_near).select("src", "dst"), ["src", "dst"]).groupBy("src").agg((F.count(F.lit(1)) / k).alias("s"))
    every = source.select(F.col("id").alias("src")).join(shared, "src", "left").select("src", F.coalesce("s", F.lit(0.0)).alias("s"))
    return every.agg(F.avg("s").alias("score"), F.min("s").alias("low"), F.max("s").alias("high"), F.count(F.lit(1)).alias("n"))


def _rank_penalty(ranked: DataFrame, candidates: DataFrame, n: int, k: int) -> DataFrame:
    if not 0 < k < n / 2:
        raise ValueError("k must be positive and less than half the number of points")
    ranks = nearer_counts(ranked, candidates)
    return ranks.agg((1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * F.sum(F.greatest(F.col("rank") - k, F.lit(0)))).alias("score"))


def trustworthiness(source: DataFrame, embedding: DataFrame, k: int = 5, embedded_near: DataFrame | None = None) -> DataFrame:
    """Penalty for embedded neighbours that are far in the source."""
    return _rank_penalty(source, _near(embedding, k, embedded_near).select("src", "dst"), source.count(), k)


def continuity(source: DataFrame, embedding: DataFrame, k: int = 5, source_near: DataFrame | None = None) -> DataFrame:
    """Penalty for source neighbours that are far in the embedding."""
    return _rank_penalty(embedding, _near(source, k, source_near).select("src", "dst"), source.count(), k)


def sq_dist(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def pair_distances(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pairs(i, j) with the distance of their points, by two equi-joins."""
    f = F.col("features").cast("array<double>")
    left = points.select(F.col("id").alias("i"), f.alias("fi"))
    right = points.select(F.col("id").alias("j"), f.alias("fj"))
    return pairs.join(left, "i").join(right, "j").withColumn("d", F.sqrt(sq_dist(F.col("fi"), F.col("fj")))).drop("fi", "fj")


def average_ranks(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the rank of a column, ties sharing their mean rank.

    Distinct values are sorted in ranges and counted, ranges are offset by the rows before them (one number a
    range reaches the driver), and ranks are joined back; no task holds all rows.
    """
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    dealt = saved(counts.repartitionByRange(column).withColumn("__p", F.spark_partition_id()))
    sizes = {r["__p"]: r.s for r in dealt.groupBy("__p").agg(F.sum("__n").alias("s")).collect()}  # one row a range
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    before = rows.sparkSession.createDataFrame(starts, "__p int, __start long")
    upto = F.sum("__n").over(Window.partitionBy("__p").orderBy(column))
    ranks = dealt.withColumn("__upto", upto).join(F.broadcast(before), "__p").select(column, (F.col("__start") + F.col("__upto") - (F.col("__n") - 1) / 2).alias(out))
    return rows.join(ranks, column)


def correlation(x: str, y: str):
    """Pearson's correlation as an aggregate; null where a column is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns over the rows that have both; null where a column is constant or there are no rows."""
    rows = saved(rows.select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL"))
    ranked = average_ranks(average_ranks(rows, "x", "rx"), "y", "ry")
    # twice a mean rank is whole: the sums are exact, so that no order of the rows changes the result
    u, v = ((2 * F.col(c)).cast("long") for c in ("rx", "ry"))
    exact = lambda a, b: F.sum(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"))
    r = ranked.agg(F.count(F.lit(1)).alias("n"), exact(u, F.lit(1)).cast("string").alias("u"), exact(v, F.lit(1)).cast("string").alias("v"), exact(u, u).cast("string").alias("uu"), exact(v, v).cast("string").alias("vv"), exact(u, v).cast("string").alias("uv")).first()
    rho = None
    if r.n:
        uu, vv, uv = (r.n * int(r[a + b]) - int(r[a]) * int(r[b]) for a, b in ("uu", "vv", "uv"))
        rho = uv / (math.sqrt(uu) * math.sqrt(vv)) if uu and vv else None
    return rows.sparkSession.createDataFrame([(rho, r.n)], "rho double, n_pairs long")


def p_value(rho: float, n: int) -> float:
    """Two-sided chance of a correlation at least as strong, from Student's t with n - 2 degrees of freedom."""
    if n < 3 or math.isnan(rho):
        return math.nan
    if rho == 0 or abs(rho) >= 1:
        return float(rho == 0)
    # the incomplete beta function at 1 - rho**2, with a = (n - 2) / 2 and b = 1 / 2, by Lentz's continued fraction
    a, b, x = (n - 2) / 2, 0.5, 1 - rho * rho
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        out = d
        for m in range(1, 500):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + k * d
                c = 1 + k / c
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = c if abs(c) > 1e-300 else 1e-300
                out *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return out

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


#: All pairs up to which they are stored and sorted.
SORTED = 1 << 23


def distance_spearman(source: DataFrame, embedding: DataFrame, pairs: DataFrame | None = None, digits: int = 6, stored: int = SORTED) -> DataFrame:
    """Rank correlation of distances in both sets of vectors: over the given pairs(i, j), or over all pairs in blocks.

    Of all pairs, more than ``stored`` are counted without storing one, and rho is right when rounded to ``digits``
    decimals. Where no count decides those (most distances lie in few very narrow ranges), pairs are stored and sorted.
    """
    if pairs is None:
        n = source.count()
        found = correlation_of_pairs(source, embedding, digits) if n * (n - 1) // 2 > stored else None
        if found is not None:
            return source.sparkSession.createDataFrame([found], "rho double, n_pairs long")
        return spearman(pair_distances_by_block(source, embedding), "x", "y")
    both = pair_distances(pairs, source).withColumnRenamed("d", "x").join(pair_distances(pairs, embedding).withColumnRenamed("d", "y"), ["i", "j"])
    return spearman(both, "x", "y")


def triplet_accuracy(triplets: DataFrame, source: DataFrame, embedding: DataFrame) -> DataFrame:
    """triplets(t, a, i, j): agreement over triplets that the source does not tie; embedded ties are wrong."""

    def sign(points: DataFrame, name: str) -> DataFrame:
        one = pair_distances(triplets.select("t", F.col("a").alias("i"), F.col("i").alias("j")), points).select("t", F.col("d").alias("d1"))
        two = pair_distances(triplets.select("t", F.col("a").alias("i"), "j"), points).select("t", F.col("d").alias("d2"))
        return one.join(two, "t").select("t", F.signum(F.col("d1") - F.col("d2")).alias(name))

    both = sign(source, "s").join(sign(embedding, "e"), "t").filter("s <> 0")
    return both.agg(F.avg((F.col("s") == F.col("e")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n_used"), F.count_if(F.col("e") == 0).alias("n_embedded_ties"))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) of labels: adjusted Rand index from the contingency counts; 1 where both sides can't but agree
    (one label each, or none twice), null without pairs. A null label is a label like any other."""
    two = lambda c: c * (c - 1) / 2
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = cells.agg(F.sum(two(F.col("n"))).alias("c"), F.sum("n").alias("m"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("rb"))
    one = total.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.coalesce(F.try_divide(F.col("ra") * F.col("rb"), two(F.col("m"))), F.lit(0.0))
    most = (F.col("ra") + F.col("rb")) / 2
    ari = F.when(F.col("m").isNull(), F.lit(None)).when(most == expected, F.lit(1.0)).otherwise(F.try_divide(F.col("c") - expected, most - expected))
    return one.select(ari.cast("double").alias("ari"))
