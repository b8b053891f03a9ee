"""Near repulsion in crowded cells, and bootstrap intervals."""

import numpy as np

from fieldweave.operators import bootstrap, local


def test_crowded_cells_and_copies(spark, monkeypatch):
    """A third of the points in one place, cells cut into blocks of a few points."""
    monkeypatch.setattr(local, "BLOCK", 7)
    rng = np.random.default_rng(4)
    at = np.vstack([np.full((30, 2), 1.0), rng.normal(1, 0.2, (30, 2)), rng.uniform(0, 6, (30, 2))])
    layout = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double").repartition(3)
    got = sorted((r.src, r.dst) for r in local.near_pairs(layout, 4, 3, 0.8).collect())
    width = (at.max() - at.min()) / 4
    cell = np.minimum(np.floor((at - at.min()) / width), 3)
    expected = []
    for i in range(90):
        d2 = ((at - at[i]) ** 2).sum(1)
        ok = [j for j in range(90) if 0 < d2[j] <= 0.64 and abs(cell[i] - cell[j]).max() <= 1]
        expected += [(i, j) for j in sorted(ok, key=lambda j: (d2[j], j))[:3]]
    assert got == sorted(expected)
    assert local.density_threshold(layout.filter("1 = 0"), 4, 0.5) == float("inf")
    counts = np.unique(cell, axis=0, return_counts=True)[1]
    assert local.density_threshold(layout, 4, 0.9) == np.quantile(counts, 0.9)
    assert local.local_repulsion(layout.filter("1 = 0"), 4, 3, 0.8).collect() == []


def test_poisson_weights(spark):
    w = np.array([r.w for r in spark.range(20000).select(bootstrap.poisson_weight("id").alias("w")).collect()])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06 and abs((w == 0).mean() - np.exp(-1)) < 0.02


def test_intervals_hold_the_median_and_ignore_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(g, 100 * g + i, float(x)) for g in range(40) for i, x in enumerate(rng.normal(5, 1, 30))]
    rows += [(100, 1, 3.0), (101, 1, None), (101, 2, float("nan")), (None, 7, 1.0), (None, 8, 2.0)]
    table = spark.createDataFrame(rows, "g long, k long, v double")
    found = lambda t: {r.g: r for r in bootstrap.intervals(t, ["g"], "v", "k", 200).collect()}
    one, two = found(table.repartition(1)), found(table.repartition(7, "k"))
    assert one == two and 101 not in one and (one[100].low, one[100].high) == (3.0, 3.0) and one[None].n == 2
    held = [one[g].low <= 5 <= one[g].high for g in range(40)]
    assert sum(held) >= 34 and all(one[g].low <= one[g].median <= one[g].high for g in one)
    # as wide as resampling in NumPy makes them
    x = np.array([v for g, _, v in rows if g == 3])
    medians = np.median(rng.choice(x, (4000, 30)), axis=1)
    assert abs((one[3].high - one[3].low) - np.subtract(*np.percentile(medians, [97.5, 2.5]))) < 0.35
