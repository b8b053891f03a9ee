"""Sparse sources and decompositions against NumPy."""

import numpy as np
import pytest

from fieldweave.operators import svd
from fieldweave.sources import csr


def entries_of(spark, x):
    return spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "row long, col long, value double").repartition(4)


@pytest.mark.parametrize("oversample", [6, 20])
def test_components_equal_numpy(spark, oversample):
    """Exactly where the range finder has as many directions as the table columns, else to the gap between singular values."""
    rng = np.random.default_rng(0)
    x = rng.poisson(0.7, (90, 25)).astype(float) * 0.6 ** np.arange(25)
    features, s, loadings = svd.truncated_svd(entries_of(spark, x), 6, oversample, power=2 if oversample == 6 else 0)
    u, t, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, t[:6], rtol=1e-4 if oversample == 6 else 1e-9)
    right = np.array([r.loadings for r in loadings.orderBy("col").collect()])
    assert np.allclose(right.T @ right, np.eye(6), atol=1e-8) and (right.max(0) >= -right.min(0) - 1e-12).all()
    left = np.zeros((90, 6))
    for r in features.collect():
        left[r.row] = r.features
    assert np.allclose(np.abs(left), np.abs(u[:, :6] * t[:6]), atol=1e-3)
    assert np.allclose(left, x @ right, atol=1e-3)


def test_low_rank_awkward_and_empty_tables(spark):
    x = np.outer([1.0, 2.0, 0.0, 3.0], [1.0, 0.0, -4.0])
    odd = spark.createDataFrame([(None, 1, 5.0), (1, None, 5.0), (1, 1, None), (1, 1, float("nan")), (0, 0, 0.25), (0, 0, -0.25)], "row long, col long, value double")
    table = entries_of(spark, x).union(odd)
    features, s, loadings = svd.truncated_svd(table, 3)
    assert len(s) == 1 and abs(s[0] - np.linalg.norm(x)) < 1e-9
    got = {(r.row, r.col): r.value for r in svd.reconstructed(entries_of(spark, x), features, loadings).collect()}
    assert all(abs(got[i, j] - x[i, j]) < 1e-9 for i, j in zip(*np.nonzero(x), strict=True))
    assert svd.truncated_svd(table.filter("1 = 0"), 3)[1] == []
    with pytest.raises(ValueError):
        svd.truncated_svd(table, 0)


@pytest.fixture
def folder(tmp_path):
    x = np.random.default_rng(1).poisson(0.3, (57, 9)).astype(np.float32)
    x[10] = 0
    rows, cols = np.nonzero(x)
    np.save(tmp_path / "indptr.npy", np.r_[0, np.cumsum(np.bincount(rows, minlength=57))])
    np.save(tmp_path / "indices.npy", cols.astype(np.int32))
    np.save(tmp_path / "data.npy", x[rows, cols])
    np.save(tmp_path / "shape.npy", np.array([57, 9]))
    return tmp_path, x


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.row, r.col] = r.value
    return out


def test_sparse_rows(spark, folder):
    path, x = folder
    assert np.array_equal(dense(csr.read_csr(spark, str(path), rows_per_task=10), x.shape), x)
    some = csr.read_csr(spark, str(path), 20, 35, rows_per_task=10)
    assert some.rdd.getNumPartitions() == 2
    assert np.array_equal(dense(some, x.shape)[20:35], x[20:35]) and some.filter("row < 20 OR row >= 35").count() == 0
    wanted = spark.createDataFrame([(3, 0), (3, 1), (10, 2)], "row long, new_row long")
    got = dense(csr.select_rows(csr.read_csr(spark, str(path)), wanted), (3, 9))
    assert np.array_equal(got, x[[3, 3, 10]])


def test_filters_drop_ranges(spark, folder):
    path, x = folder
    reader = csr.CsrReader({"path": str(path), "rows_per_task": "10"})
    list(reader.pushFilters([csr.GreaterThanOrEqual(("row",), 30), csr.LessThan(("row",), 45), csr.EqualTo(("col",), 3)]))
    assert [(p.first, p.end) for p in reader.partitions()] == [(30, 40), (40, 45)]
    found = csr.read_csr(spark, str(path), rows_per_task=10).filter("row >= 30 AND row < 45")
    assert found.rdd.getNumPartitions() == 2
    assert np.array_equal(dense(found, x.shape)[30:45], x[30:45])


def test_contradicting_arrays(spark, folder):
    path, _ = folder
    np.save(path / "shape.npy", np.array([58, 9]))
    with pytest.raises(Exception, match="contradict"):
        csr.read_csr(spark, str(path)).collect()
    np.save(path / "shape.npy", np.array([57, 4]))
    with pytest.raises(Exception, match="outside the shape"):
        csr.read_csr(spark, str(path)).collect()
