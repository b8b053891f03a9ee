"""Measures on input without extent, variation or rows have defined results."""

from fieldweave.operators import quality, stability


def test_agreement_of_single_labels(spark):
    ari = lambda rows: quality.adjusted_rand(spark.createDataFrame(rows, "a int, b int")).first().ari
    assert ari([(1, 1)] * 5) == 1.0 and ari([(1, 1)]) == 1.0 and ari([]) is None
    assert ari([(i, i) for i in range(4)]) == 1.0 and ari([(1, i) for i in range(4)]) == 0.0
    assert ari([(None, 1), (None, 1), (2, 3), (2, 3)]) == 1.0


def test_rank_correlation_of_constants_and_nulls(spark):
    rho = lambda rows: quality.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert rho([(1.0, 2.0), (1.0, 3.0)]).rho is None
    got = rho([(1.0, 1.0), (2.0, 2.0), (2.5, None), (None, 0.5), (3.0, 3.0)])
    assert abs(got.rho - 1) < 1e-12 and got.n_pairs == 3
    assert tuple(rho([])) == (None, 0)


def test_collapsed_layouts(spark):
    flat = spark.createDataFrame([(i, 3.0, 3.0) for i in range(4)], "id long, x double, y double")
    wide = spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], "id long, x double, y double")
    assert stability.procrustes(flat, flat).first().rms == 0
    assert abs(stability.procrustes(flat, wide).first().rms - 0.5) < 1e-12
