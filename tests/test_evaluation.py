"""The store of neighbour tables, measures that share them, and permutation with a refit."""

from fieldweave.functions.columns import numbered
from fieldweave.operators import evaluation
from fieldweave.plans import registry


def test_tables_are_shared_and_kept(spark, sf, tmp_path):
    points, flat = registry.points(spark, sf), registry.projected(spark, sf)
    store = evaluation.Store(spark, str(tmp_path))
    one = evaluation.evaluate(store, points, flat, 10, n_triplets=2, n_pairs=300).first()
    assert len(store.made) == 2 and {r.kind for r in store.ledger().collect()} == {"knn"}
    again = evaluation.Store(spark, str(tmp_path))
    assert evaluation.evaluate(again, points.repartition(3), flat, 10, n_triplets=2, n_pairs=300).first() == one
    assert again.made == [] and again.ledger().count() == 2
    assert 0 <= one.preservation <= 1 and one.n == points.count() and -1 <= one.distance_rho <= 1


def test_numbers_within_groups(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 AS g", "(id * 7919) % 1000 AS h").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(rows, "g", ["h", "id"], "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in range(3):
        mine = sorted((r.h, r.n) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_permutation_calls_the_fit_afresh(spark):
    points = spark.createDataFrame([(i, [float(i % 7), float(i), float(-i)]) for i in range(40)], "id long, features array<double>")
    seen = []

    def fit(p):
        seen.append(sorted(tuple(r.features) for r in p.collect()))
        return p.selectExpr("id", "slice(features, 2, 2) AS features")

    got = evaluation.reliability_by_permutation(points, fit).collect()
    assert len(got) == 40 and {r.label for r in got} <= {"dubious", "intermediate", "trustworthy"}
    assert len(seen) == 2 and seen[0] != seen[1]
    assert [sorted(c) for c in zip(*seen[0], strict=True)] == [sorted(c) for c in zip(*seen[1], strict=True)]  # marginals stay
