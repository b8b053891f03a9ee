from math import exp, lgamma, log

import numpy as np
import pytest

from fieldweave.operators import matching, quantiles, targets


def _points(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double")


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    many = np.concatenate([rng.normal(size=2500), np.full(2400, 0.25), rng.integers(0, 4, 600)])
    for values in (many, np.full(3000, 7.0), np.array([3.0]), np.repeat([1.0, 2.0], 1500)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(4)
        for q in (0.0, 0.5, 0.951, 1.0) if len(values) > 5000 else (0.5,):
            assert quantiles.quantile(df, "v", q) == pytest.approx(np.quantile(values, q), abs=1e-12)
    assert quantiles.quantile(spark.createDataFrame([], "v double"), "v", 0.5) is None


def test_targets_equal_plain_ranking(spark):
    rng = np.random.default_rng(1)
    at = rng.normal(size=(40, 2))
    layout = _points(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(at)])
    w = rng.uniform(0, 1, (40, 40)) * (rng.uniform(size=(40, 40)) < 0.2)
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "src long, dst long, w double")
    found = {}
    for r in targets.select_targets(layout, edges, 10, 6).orderBy("place").collect():
        found.setdefault(r.target_group, []).append(r.id)
    gaps = np.sort(np.linalg.norm(at[:, None] - at[None], axis=2), axis=1)[:, 7]
    out = np.linalg.norm(at - np.median(at, axis=0), axis=1)
    for name, key in (("high_degree", -w.sum(1)), ("dense_region", gaps), ("radial_tail", -out)):
        assert found[name] == np.argsort(key, kind="stable")[:6].tolist()
    assert len(set(found["random"])) == 10
    few = targets.select_targets(layout.limit(3), edges.limit(0), 10, 6).groupBy("target_group").count().collect()
    assert {r["count"] for r in few} == {3} and len(few) == 4
    assert targets.select_targets(layout.limit(0), edges.limit(0), 10, 6).count() == 0


def test_errors_equal_numpy(spark):
    rng = np.random.default_rng(2)
    exact = rng.normal(size=(20, 2))
    exact[3] = 0
    near = exact + rng.normal(size=(20, 2)) * 0.1
    chosen = [("a", p, i) for p, i in enumerate(range(0, 12))] + [("b", p, i) for p, i in enumerate(range(8, 20))]
    frame = lambda v: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(v)], "id long, fx double, fy double")
    got = {r.target_group: r for r in targets.error_rows(frame(exact), frame(near), spark.createDataFrame(chosen, "target_group string, place int, id long"), 0.01).collect()}
    norm, other = np.linalg.norm(exact, axis=1), np.linalg.norm(near, axis=1)
    floor = np.median(norm) * 0.01
    relative = np.linalg.norm(near - exact, axis=1) / np.maximum(norm, floor)
    valid = (norm > floor) & (other > floor)
    angle = np.degrees(np.arccos(np.clip((exact * near).sum(1) / np.maximum(norm * other, floor**2), -1, 1)))
    for name, at in (("a", np.arange(12)), ("b", np.arange(8, 20))):
        r = got[name]
        assert (r.n_targets, r.n_valid_angles, r.n_near_zero) == (12, valid[at].sum(), (norm[at] <= floor).sum())
        assert r.floor == pytest.approx(floor)
        assert r.relative_error_p95 == pytest.approx(np.percentile(relative[at], 95))
        assert r.relative_error_max == pytest.approx(relative[at].max())
        assert r.angle_median_deg == pytest.approx(np.median(angle[at][valid[at]]))
        assert r.norm_error_median == pytest.approx(np.median(np.abs(other - norm)[at] / np.maximum(norm, floor)[at]))


def _information(a, b):
    """Adjusted mutual information by its textbook sums."""
    total, table = len(a), np.zeros((max(a) + 1, max(b) + 1))
    np.add.at(table, (a, b), 1)
    x, y = table.sum(1), table.sum(0)
    mutual = sum(n / total * log(n * total / (x[i] * y[j])) for (i, j), n in np.ndenumerate(table) if n)
    entropy = lambda s: -sum(n / total * log(n / total) for n in s if n)
    fact, expected = lambda n: lgamma(n + 1), 0.0
    for p in x[x > 0].astype(int):
        for q in y[y > 0].astype(int):
            for n in range(max(1, p + q - total), min(p, q) + 1):
                chance = exp(fact(p) + fact(q) + fact(total - p) + fact(total - q) - fact(total) - fact(n) - fact(p - n) - fact(q - n) - fact(total - p - q + n))
                expected += n / total * log(n * total / (p * q)) * chance
    mean = (entropy(x) + entropy(y)) / 2
    return (mutual - expected) / (mean - expected)


def test_mutual_information_equals_plain_sums(spark):
    rng = np.random.default_rng(3)
    for labels in (3, 30):
        a = rng.integers(0, labels, 400)
        a[:150] = 0  # a label with over a third of all rows
        b = np.where(rng.uniform(size=400) < 0.5, a, rng.integers(0, labels + 2, 400))
        pairs = spark.createDataFrame([(int(p), int(q)) for p, q in zip(a, b)], "a long, b long")
        assert matching.adjusted_mutual_information(pairs) == pytest.approx(_information(a, b), abs=1e-9)
    assert matching.adjusted_mutual_information(spark.createDataFrame([], "a long, b long")) == 1.0
    assert matching.adjusted_mutual_information(spark.createDataFrame([(None, None), (None, None), (1, 1), (1, 1)], "a long, b long")) == pytest.approx(1)
