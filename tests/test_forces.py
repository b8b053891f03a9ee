import numpy as np
import pytest

from fieldweave.functions import schedules
from fieldweave.operators import exact, optimisers, spectral
from fieldweave.plans import registry

RNG = np.random.default_rng(3)
P = RNG.normal(size=(40, 2)) * 2
W = {(i, int(j)): float(RNG.random()) for i in range(40) for j in RNG.choice([j for j in range(40) if j != i], 3, replace=False)}


@pytest.fixture(scope="module")
def layout(spark):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(P)], "id long, x double, y double")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, j, w) for (i, j), w in W.items()], "src long, dst long, w double")


def got(df):
    return np.array([[r.fx, r.fy] for r in df.orderBy("id").collect()])


def gaps():
    g = P[:, None] - P[None]
    return g, (g * g).sum(2)


def test_repulsion(layout, edges):
    g, d2 = gaps()
    pair = np.clip((2 * 0.895 / ((1e-3 + d2) * (1 + 1.577 * d2**0.895)))[:, :, None] * g, -4, 4)
    assert np.allclose(got(exact.exact_repulsion(layout)), pair.sum(1))
    w = np.ones((40, 40))
    for (i, j), x in W.items():
        w[i, j] -= x
    assert np.allclose(got(exact.expected_repulsion(layout, edges)), (pair * w[:, :, None]).sum(1))
    assert np.allclose(got(exact.t_repulsion(layout, 2.0, 1.5)), (2 * (1 + d2) ** -1.5)[:, :, None].repeat(2, 2).__mul__(g).sum(1))


def test_attractions(layout, edges):
    want, bounded = np.zeros((40, 2)), np.zeros((40, 2))
    for (i, j), w in W.items():
        g = P[i] - P[j]
        d2 = g @ g
        want[i] += np.clip(-2 * w * 1.577 * 0.895 * d2 ** (0.895 - 1) / (1 + 1.577 * d2**0.895) * g, -4, 4)
        bounded[i] -= (8 / (1 + d2) + 0.5) * g
    assert np.allclose(got(exact.weighted_attraction(edges, layout)), want)
    biased = exact.edge_bias(edges)
    assert biased.filter("bias <> 0.5").count() == 0  # every vertex has three edges
    assert np.allclose(got(exact.t_attraction(biased, layout)), bounded)


def test_noise_and_constraints(spark, layout):
    fixed = spark.createDataFrame([(3,), (4,)], "id long")
    noisy = {r.id: (r.x, r.y) for r in exact.add_noise(layout, 0.5, 7, fixed).collect()}
    moved = np.array([noisy[i] for i in range(40)]) - P
    assert not moved[3].any() and not moved[4].any() and 0.3 < moved[5:].std() < 0.7
    known = spark.createDataFrame([(2, 1.0, -1.0)], "id long, px double, py double")
    put = {r.id: (r.x, r.y) for r in exact.constrained(layout, known).collect()}
    assert put[2] == (1.0, -1.0) and put[1] == tuple(P[1])


def test_pressure_and_radius(layout, edges):
    assert exact.density_pressure(layout, 2, 5).count() > 0 == exact.density_pressure(layout, 2, 40).count()
    want = np.median([np.linalg.norm(P[i] - P[j]) for i, j in W])
    assert exact.local_radius(edges, layout, 2.0).first().radius == pytest.approx(2 * want)


def test_loops_stay_finite(layout, edges):
    for out in (optimisers.sampled_layout(edges, layout, 4, save_every=2), optimisers.t_layout(edges, layout, 3, save_every=2)):
        at = np.array([[r.x, r.y] for r in out.collect()])
        assert at.shape == (40, 2) and np.isfinite(at).all()


def test_spectral_positions(spark):
    n = 24  # two rings, the first wider
    ring = [(i, (i + 1) % 16, 1.0) for i in range(16)] + [(16 + i, 16 + (i + 1) % 8, 1.0) for i in range(8)]
    edges = spark.createDataFrame(ring, "src long, dst long, w double")
    one = spectral.spectral_layout(spark.range(16), edges.filter("src < 16"), rounds=6)
    at = np.array([[r.x, r.y] for r in one.orderBy("id").collect()])
    assert np.allclose((at**2).sum(1), 2 / 16, atol=0.03)  # a ring is laid out as a circle
    both = {r.id: (r.x, r.y) for r in spectral.spectral_init(spark.range(n), edges, rounds=3).collect()}
    # two components lie around (1, 0) and (-1, 0), each within half the way to the other
    assert len(both) == n and min(both[i][0] for i in range(16)) > -1e-9 > max(both[i][0] for i in range(16, n)) - 2e-9


def test_schedules():
    assert schedules.stages(200, [(0, 1), (0.9, 2), (0.95, 3)]) == [(0, 180, 1), (180, 190, 2), (190, 200, 3)]
    assert schedules.stage_at([(0, 180, 1), (180, 200, 2)], 180) == 2
    assert [schedules.alpha(t, 10) for t in (0, 1, 2)] == [1.0, 1.0, 0.9]
    assert schedules.split_epochs(10, 0.01) == (9, 1) and schedules.split_epochs(10, 0.99) == (1, 9) and schedules.split_epochs(11, 0.3) == (7, 4)
    with pytest.raises(ValueError):
        schedules.stages(3, [(0, 1), (0.1, 2), (0.2, 3)])
    assert all(w <= schedules.rounded_width(w) < w * 2 ** (1.001 / 64) for w in (0.3, 1.0, 1.7))
    assert schedules.noise_scale(5, 10, 2.0, "linear") == 1.0 and schedules.noise_scale(9, 10, 2.0, stop=0.5) == 0
    assert schedules.mesh_cells(10) == 32 and schedules.mesh_cells(100) == 105


def test_forces_of_some_are_those_of_all(spark):
    at = spark.createDataFrame([(i, (i * 7) % 31 / 3.0, (i * 11) % 29 / 5.0) for i in range(90)], "id long, x double, y double")
    every = {r.id: (r.fx, r.fy) for r in exact.exact_repulsion(at).collect()}
    some = exact.exact_repulsion(at, of=at.filter("id % 9 = 4").union(at.filter("id = 4"))).collect()
    assert sorted(r.id for r in some) == list(range(4, 90, 9))
    assert all(abs(r.fx - every[r.id][0]) < 1e-9 and abs(r.fy - every[r.id][1]) < 1e-9 for r in some)


def test_edges_are_computed_once(spark, sf):
    assert "MapInArrow" not in registry.edges(spark, sf)._jdf.queryExecution().toString()
