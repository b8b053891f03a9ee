"""The mesh by Fourier transform against the cell-by-cell sum and the exact forces."""

import numpy as np
import pytest

from fieldweave.operators import exact, field, mesh
from fieldweave.operators import layout as layout_module
from fieldweave.operators.layout import FieldLayout
from fieldweave.operators.neighbors import knn


def cloud(spark, n=400, seed=0, spread=4.0):
    at = np.random.default_rng(seed).normal(0, spread, (n, 2))
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")


def forces(df):
    return np.array([[r.fx, r.fy] for r in df.orderBy("id").collect()])


def test_order_one_is_the_sum_over_cells(spark):
    layout = cloud(spark)
    assert np.abs(forces(mesh.mesh_force(layout, 12)) - forces(field.mesh_repulsion(layout, 12))).max() < 1e-9


def test_any_order_is_the_sum_over_nodes(spark):
    """The transform changes nothing: nodes, weights and the convolution written out in NumPy."""
    layout, boxes, order = cloud(spark, 80), 6, 3
    at = np.array([[r.x, r.y] for r in layout.orderBy("id").collect()])
    low = at.min()
    width = (at.max() - low) / boxes
    box = np.minimum(np.floor((at - low) / width), boxes - 1).astype(int)
    u = (at - low) / width - box
    nodes = (np.arange(order) + 0.5) / order
    w = np.stack([np.prod([(u - nodes[k]) / (nodes[j] - nodes[k]) for k in range(order) if k != j], axis=0) for j in range(order)], axis=-1)
    table = mesh.Repulsion(near=2).table(boxes * order, width / order)
    charge = np.zeros((boxes * order, boxes * order, 3))
    for i in range(len(at)):
        for j in range(order):
            for k in range(order):
                charge[box[i, 0] * order + j, box[i, 1] * order + k] += w[i, 0, j] * w[i, 1, k] * np.r_[at[i], 1.0]
    n = boxes * order
    off = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    potential = np.einsum("acbd,bdt->act", table[off[:, None, :, None], off[None, :, None, :]], charge)
    expected = np.zeros_like(at)
    for i in range(len(at)):
        for j in range(order):
            for k in range(order):
                p = potential[box[i, 0] * order + j, box[i, 1] * order + k] * w[i, 0, j] * w[i, 1, k]
                expected[i] += p[2] * at[i] - p[:2]
    got = forces(mesh.mesh_force(layout, boxes, order, mesh.Repulsion(near=2)))
    assert np.abs(got - expected).max() < 1e-9 * max(1, np.abs(expected).max())


def test_error_falls_with_the_order(spark):
    layout = cloud(spark)
    exactly = forces(exact.t_repulsion(layout))
    errors = [np.sqrt(((forces(mesh.mesh_force(layout, 16, order, mesh.BoundedRepulsion())) - exactly) ** 2).mean()) for order in (1, 2, 3, 4)]
    assert all(b < a / 2 for a, b in zip(errors, errors[1:], strict=False)) and errors[3] < 0.1


def test_averaged_kernel_near_the_origin():
    plain, averaged = mesh.Repulsion(clip=1e9).table(8, 0.5), mesh.Repulsion(clip=1e9, near=1, samples=4).table(8, 0.5)
    at = (np.arange(4) + 0.5) / 4 * 0.5 - 0.25
    mean = np.mean([mesh.Repulsion().of(x * x + (0.5 + y) ** 2) for x in at for y in at])
    assert abs(averaged[0, 1] - mean) < 1e-12 and averaged[0, 0] < plain[0, 0]
    assert np.array_equal(plain[2:], averaged[2:]) and np.array_equal(plain[:, 2:], averaged[:, 2:])


@pytest.mark.parametrize("order", [1, 2])
def test_points_without_extent(spark, order):
    together = spark.createDataFrame([(1, 2.0, 2.0), (2, 2.0, 2.0)], "id long, x double, y double")
    for layout in (together, together.limit(1)):
        assert np.abs(forces(mesh.mesh_force(layout, 8, order))).max() < 1e-12
        assert np.abs(forces(field.mesh_repulsion(layout, 8))).max() < 1e-12
    assert exact.density_pressure(together, 8, 1).count() == 2
    assert mesh.mesh_force(together.filter("1 = 0"), 8, order).collect() == []


def test_fine_mesh(spark):
    assert mesh.mesh_force(cloud(spark, 50), 1024).count() == 50
    with pytest.raises(ValueError):
        mesh.mesh_force(cloud(spark, 5), 2048, 3)


def test_layout_with_stages_constraints_and_noise(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(layout_module, "approximate_knn", lambda p, k, metric, seed: asked.append(k) or knn(p, k, metric))
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4) * 0.2 + (i % 2) * 8]) for i in range(40)], "id long, features array<double>")
    known = spark.createDataFrame([(0, 1.0, 2.0), (1, 9.0, 9.0)], "id long, px double, py double")
    model = FieldLayout(n_neighbors=5, n_epochs=2, boxes=8, neighbors="approximate", stages=((0.0, 1), (0.5, 2)), total_clip=1.0, noise=0.01)
    at = {r.id: (r.x, r.y) for r in model.fit_transform(points, known=known).collect()}
    assert asked == [4] and len(at) == 40 and at[0] == (1.0, 2.0) and at[1] == (9.0, 9.0) and np.isfinite(list(at.values())).all()
    soft = FieldLayout(n_neighbors=5, n_epochs=2, boxes=8, constraint_weight=0.5)
    start = points.selectExpr("id", "CAST(id AS DOUBLE) AS x", "0D AS y")
    far = spark.createDataFrame([(3, 500.0, 500.0)], "id long, px double, py double")
    pulled = {r.id: (r.x, r.y) for r in soft.fit_transform(points, init=start, known=far).collect()}
    assert pulled[3][0] > 100 and max(x for i, (x, _) in pulled.items() if i != 3) < 100
    for bad in ({"stages": ((0.0, 2), (0.5, 1))}, {"stages": ((0.0, 1), (0.9, 2)), "n_epochs": 1}, {"init": "pca"}, {"neighbors": "some"}):
        with pytest.raises(ValueError):
            FieldLayout(**bad)


def test_spectral_start(spark):
    """A ring's spectral positions are a ring: neighbours stay nearer than opposite points."""
    ring = spark.createDataFrame([(i, (i + 1) % 12, 1.0) for i in range(12)], "src long, dst long, w double")
    ready = FieldLayout(init="spectral").prepare_from_graph(ring.selectExpr("src AS id"), ring)
    at = {r.id: np.array([r.x, r.y]) for r in ready["init"].collect()}
    gap = lambda i, j: np.linalg.norm(at[i] - at[j])
    assert len(at) == 12 and max(gap(i, (i + 1) % 12) for i in at) < min(gap(i, (i + 6) % 12) for i in at)
