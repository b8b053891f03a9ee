"""Every plan with an oracle against DuckDB on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from fieldweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = con.sql(registry.oracle_sql()[name])
    columns = sorted(expected.columns)
    got = registry.queries()[name](spark, sf)
    assert sorted(got.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    rows = lambda x: Counter(str([plain(v) for v in r]) for r in x)
    assert rows(got.select(*columns).collect()) == rows(tuple(r[i] for i in at) for r in expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_fuzzy_weights_reach_their_mass(spark, sf):
    import numpy as np

    from fieldweave.operators.graph import fuzzy_weights
    from fieldweave.operators.neighbors import knn

    near = knn(registry.points(spark, sf), 10).toPandas().sort_values(["src", "rank"])
    sigma = {}
    for src, g in near.groupby("src"):
        d = np.maximum(g.dist.to_numpy() - g.dist.min(), 0)
        lo, hi, mid = 0.0, np.inf, 1.0
        for _ in range(64):
            if np.exp(-d / mid).sum() > np.log2(11):
                hi = mid
            else:
                lo = mid
            mid = mid * 2 if hi == np.inf else (lo + hi) / 2
        sigma.update({(src, t): w for t, w in zip(g.dst, np.exp(-d / mid))})
    for r in fuzzy_weights(knn(registry.points(spark, sf), 10)).collect():
        a, b = sigma.get((r.src, r.dst), 0.0), sigma.get((r.dst, r.src), 0.0)
        assert abs(r.w - (a + b - a * b)) < 1e-6
