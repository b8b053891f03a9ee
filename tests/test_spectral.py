"""Spectral positions of many components at once, and the places of components."""

import numpy as np

from fieldweave.operators import connected, spectral
from fieldweave.operators.saving import saved


def eigen(w):
    d = w.sum(1)
    values, vectors = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    return values[::-1], vectors[:, ::-1]


def test_every_component_has_its_own_eigenvectors(spark):
    rng = np.random.default_rng(3)
    rows, matrices, start = [], {}, 0
    for n in (9, 14, 25):
        w = np.triu((rng.random((n, n)) < 0.5) * rng.random((n, n)), 1)
        w[range(n - 1), range(1, n)] = 0.6  # connected
        matrices[start] = w + w.T
        rows += [(start + int(i), start + int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)]
        start += n
    edges = spark.createDataFrame(rows, "src long, dst long, w double").repartition(4)
    at = saved(connected.components(spark.range(start), edges))
    assert {r.component for r in at.select("component").distinct().collect()} == set(matrices)
    got = spectral.spectral_layouts(at, edges, rounds=10, tolerance=1e-10).collect()
    for root, w in matrices.items():
        values, vectors = eigen(w)
        mine = np.array([[r.x, r.y] for r in sorted((r for r in got if r.component == root), key=lambda r: r.id)])
        for j in (0, 1):
            rayleigh = mine[:, j] @ (w / np.sqrt(np.outer(w.sum(1), w.sum(1)))) @ mine[:, j] / (mine[:, j] @ mine[:, j])
            assert abs(rayleigh - values[j + 1]) < 1e-4
            assert mine[:, j].mean() <= (mine[:, j].min() + mine[:, j].max()) / 2 + 1e-12


def test_five_hundred_components(spark):
    """All in one pass, each within its reach of its place; near centroids have near places."""
    edges = spark.range(3000).selectExpr("id AS src", "6 * (id DIV 6) + (id + 1) % 6 AS dst", "1D AS w")
    points = spark.range(3000).selectExpr("id", "array(CAST(id DIV 6 AS DOUBLE) / 100, 0D) AS features")
    at = {r.id: np.array([r.x, r.y]) for r in spectral.spectral_init(spark.range(3000), edges, points, rounds=3).collect()}
    assert len(at) == 3000 and np.isfinite(list(at.values())).all()
    middle = np.array([np.mean([at[6 * c + i] for i in range(6)], axis=0) for c in range(500)])
    gap = np.linalg.norm(middle[1:] - middle[:-1], axis=1)
    assert gap.mean() < np.linalg.norm(middle[250:] - middle[:250], axis=1).mean() / 10
    assert len({tuple(np.round(m, 9)) for m in middle}) == 500


def test_few_components_lie_on_the_axes(spark):
    edges = spark.range(24).selectExpr("id AS src", "8 * (id DIV 8) + (id + 1) % 8 AS dst", "1D AS w")
    vertices = spark.range(25)  # one without edges
    got = {r.id: (r.x, r.y) for r in spectral.spectral_init(vertices, edges, rounds=4).collect()}
    middle = [np.mean([got[8 * c + i] for i in range(8)], axis=0) for c in range(3)]
    assert np.allclose(middle, [[1, 0], [0, 1], [-1, 0]], atol=0.3) and len(got) == 25
    assert spectral.spectral_init(vertices.filter("id = 24"), edges.filter("1 = 0")).count() == 1
