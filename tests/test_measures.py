import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import geodesic, matching, neighbors, quality, stability, topology
from fieldweave.operators.neighbors import distances


def test_assignment_is_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(30):
        cost = rng.integers(0, 9, (4, 5)).astype(float)
        best = min(sum(cost[i, p[i]] for i in range(4)) for p in itertools.permutations(range(5), 4))
        got = matching.assignment(cost)
        assert len(set(got)) == 4 and cost[np.arange(4), got].sum() == best


def test_labels(spark):
    rows = [(0, 5), (0, 5), (0, 5), (1, 6), (1, 6), (2, 5), (-1, -1), (-1, 6), (1, 7)]
    pairs = spark.createDataFrame(rows, "a long, b long")
    assert matching.match_labels(pairs) == {-1: -1, 5: 0, 6: 1, 7: 3}
    got = matching.label_changes(pairs).first()
    assert got.n == 9 and got.changed == pytest.approx(3 / 9) and got.noise_flips == pytest.approx(1 / 9)
    same = spark.createDataFrame([(i % 3, i % 3 + 10) for i in range(30)], "a long, b long")
    assert matching.adjusted_mutual_information(same) == pytest.approx(1)
    mixed = spark.createDataFrame([(i % 3, i // 3 % 3) for i in range(90)], "a long, b long")
    assert matching.adjusted_mutual_information(mixed) < 0.01


def test_circle_has_one_hole():
    t = np.arange(12) / 12 * 2 * np.pi
    p = np.stack([np.cos(t), np.sin(t)], 1)
    d = distances(p, p)
    scale = (d[0, 1] + d[0, 2]) / 2
    assert topology.betti_numbers(topology.diagram(d), scale) == (1, 1)
    assert topology.diagram_distance([(0, 1)], [(0, 1)]) == (0.0, 0)
    assert topology.diagram_distance([(0, 1)], [])[0] == 0.5


def test_homology_tells_a_circle_from_a_line(spark):
    t = np.arange(18) / 18 * 2 * np.pi
    make = lambda *c: spark.createDataFrame([(i, [float(x[i]) for x in c]) for i in range(18)], "id long, features array<double>")
    source = make(np.cos(t), np.sin(t), 0 * t)
    near = topology.persistent_homology_distance(source, make(np.cos(t), np.sin(t)), 12)
    far = topology.persistent_homology_distance(source, make(np.cos(t), 0 * t), 12)
    assert near["total"] < 1e-9 < far["total"]


def test_paths_and_components(spark):
    rng = np.random.default_rng(1)
    n = 14
    w = {(i, j): float(rng.integers(1, 9)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.15}
    best = np.full((n, n), np.inf)
    np.fill_diagonal(best, 0)
    for (i, j), x in w.items():
        best[i, j] = best[j, i] = x
    for k in range(n):
        best = np.minimum(best, best[:, k, None] + best[None, k])
    edges = spark.createDataFrame([(i, j, x) for (i, j), x in w.items()], "src long, dst long, w double")
    vertices = spark.range(n)
    got = {(r.source, r.id): r.d for r in geodesic.shortest_paths(edges, vertices).collect()}
    assert got == {(i, j): best[i, j] for i in range(n) for j in range(n) if np.isfinite(best[i, j])}
    roots = {r.id: r.component for r in geodesic.components(vertices, edges).collect()}
    assert roots == {i: int(np.flatnonzero(np.isfinite(best[i]))[0]) for i in range(n)}


def test_geodesics_along_a_curve(spark):
    x = np.linspace(-1, 1, 32)
    edges = spark.createDataFrame([(i, i + 1, float(x[i + 1] - x[i])) for i in range(31)], "src long, dst long, w double")
    line = spark.createDataFrame([(i, [float(x[i]), 0.0]) for i in range(32)], "id long, features array<double>")
    folded = spark.createDataFrame([(i, [abs(float(x[i])), 0.0]) for i in range(32)], "id long, features array<double>")
    some = geodesic.landmarks(spark.range(32), 5)
    full = geodesic.geodesic_correlation(edges, line, spark.range(32)).first()
    assert full.n_pairs == 32 * 31 / 2 and full.rho > 0.999
    assert geodesic.geodesic_correlation(edges, line, some).first().rho > 0.999 > geodesic.geodesic_correlation(edges, folded, some).first().rho


def test_samples_are_distinct():
    assert [tuple(p) for p in geodesic.sample_pairs(6, 99)] == list(itertools.combinations(range(6), 2))
    assert len({tuple(p) for p in geodesic.sample_pairs(50, 300)}) == 300
    t = geodesic.sample_triplets(7, 500)
    assert ((t[:, 0] != t[:, 1]) & (t[:, 0] != t[:, 2]) & (t[:, 1] != t[:, 2])).all() and t.min() == 0 and t.max() == 6


def test_tiles_are_exact(monkeypatch):
    """Screened neighbours over several blocks and tiles equal a sort of all distances, also far from the origin, tied or huge."""
    monkeypatch.setattr(neighbors, "TILE", (7, 11))
    rng = np.random.default_rng(3)
    sets = [rng.normal(size=(60, 5)), rng.integers(0, 3, (60, 2)) * 1.0, rng.normal(size=(60, 3)) * 1e-3 + 1e5, np.repeat([[0.0], [1e6]], 30, 0) + rng.normal(size=(60, 2)) * 1e-4, rng.normal(size=(60, 3)) * 1e25]
    for metric in ("euclidean", "manhattan", "chebyshev"):
        for x in sets:
            parts = np.array_split(rng.permutation(60).astype(np.int64), 4)
            rows = [(i, a.tobytes(), x[a].tobytes(), j, b.tobytes(), x[b].tobytes()) for i, a in enumerate(map(np.sort, parts)) for j, b in enumerate(map(np.sort, parts))]
            kinds = [pa.int64(), pa.binary(), pa.binary()] * 2
            batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 3]), kinds)], ["a", "a_ids", "a_vectors", "b", "b_ids", "b_vectors"]) for s in range(0, 16, 3)]
            got = [r for batch in neighbors._knn_kernel(4, metric, False)(iter(batches)) for r in zip(*(c.to_pylist() for c in batch.columns))]
            assert len(got) == 240  # one list a point, whatever the number of blocks that it meets
            d = neighbors.distances(x, x, metric)
            want = [(i, int(j), float(d[i, j])) for i in range(60) for j in [j for j in np.lexsort((np.arange(60), d[i])) if j != i][:4]]
            assert sorted(got, key=lambda r: (r[0], r[2], r[1])) == want


def test_ranks_count_strictly_nearer(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 3, (40, 2)) * 1.0, rng.normal(size=(40, 2)) * 1e-4 + 7])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    pairs = [(i, int(j)) for i in range(0, 80, 2) for j in rng.choice(80, 3, replace=False) if i != j]
    d = neighbors.distances(x, x)
    np.fill_diagonal(d, np.inf)
    got = neighbors.nearer_counts(points, spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {(r.src, r.dst): r["rank"] for r in got} == {(i, j): 1 + int((d[i] < d[i, j]).sum()) for i, j in pairs}


def test_rank_correlation_is_the_same_in_any_order(spark):
    """Exact sums: partitions and their order change no bit of it."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, 3000)
    rows = spark.createDataFrame([(float(v), float(v * v + e)) for v, e in zip(x, rng.integers(0, 900, 3000))], "x double, y double")
    found = {tuple(quality.spearman(rows.repartition(n, "y"), "x", "y").first()) for n in (1, 3, 7)}
    ranks = [np.array([(s < v).sum() + (s == v).sum() / 2 for v in s]) for s in np.array([(r.x, r.y) for r in rows.collect()]).T]
    assert len(found) == 1
    assert found.pop() == (pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-12), 3000)
    assert quality.spearman(rows.withColumn("x", F.lit(1.0)), "x", "y").first().rho is None
    assert tuple(quality.spearman(rows.filter("1 = 0"), "x", "y").first()) == (None, 0)


def test_cell_similarity_moves_no_pairs(spark, monkeypatch):
    """Equal to brute force, ties and points without a vector on one side included; no shuffle follows the pairs."""
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 4, (50, 3)) * 1.0, rng.normal(size=(50, 2))
    source = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    flat = spark.createDataFrame([(i, v.tolist() if i != 7 else None) for i, v in enumerate(y)], "id long, features array<double>")
    found = stability.cell_similarity(source, flat)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow")
    got = {r.src: r.rho for r in found.collect()}
    want = {}
    for i in (j for j in range(50) if j != 7):
        others = [j for j in range(50) if j != i]
        far = lambda p, j: float(neighbors.distances(p[[i]], p[[j]])[0, 0])  # noqa: B023, E731
        near = sorted(others, key=lambda j: (far(x, j), j))[:25]
        e = sorted(far(y, j) for j in others if j != 7)[:25]
        pairs = [(far(y, j), b) for j, b in zip(near, e) if j != 7]
        want[i] = np.corrcoef(*zip(*pairs))[0, 1]
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_lists_of_tasks_merge_by_block(spark, monkeypatch):
    """Hits of several tiles are worked off together; lists of many tasks come as one row a block and merge with ties by id."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 3, (300, 2)) * 1.0, rng.normal(size=(300, 2))])
    monkeypatch.setattr(neighbors, "BLOCK", 40)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    packed = neighbors.wide_blocks(points, 4)
    pairs = neighbors.block_pairs(packed.toDF("a", "a_ids", "a_vectors"), packed.toDF("b", "b_ids", "b_vectors"))
    lists = pairs.mapInArrow(neighbors._knn_kernel(4, "euclidean", False, True), "block long, src binary, dst binary, dist binary")
    blocks, n, most = packed.count(), spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    assert blocks > n // 2 and lists.count() <= blocks * (n // 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    got = [tuple(r) for r in neighbors.knn(points, 4).orderBy("src", "rank").collect()]
    d = neighbors.distances(x, x)
    want = [(i, int(j), r, float(d[i, j])) for i in range(600) for r, j in enumerate([j for j in np.lexsort((np.arange(600), d[i])) if j != i][:4], 1)]
    assert got == want


def test_insertion_equals_sorting(monkeypatch):
    """New neighbours put in their places one by one give what sorting gives."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, (200, 3)) * 1.0
    rows = [(0, np.arange(100).tobytes(), x[:100].tobytes(), j, np.arange(j, 200, 5).tobytes(), x[j::5].tobytes()) for j in range(5)]
    kinds = [pa.int64(), pa.binary(), pa.binary()] * 2
    found = []
    for most in (0, 1 << 20):
        monkeypatch.setattr(neighbors, "INSERTED", most)
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["a", "a_ids", "a_vectors", "b", "b_ids", "b_vectors"])]
        found.append([r for batch in neighbors._knn_kernel(6, "euclidean", False)(iter(batches)) for r in zip(*(c.to_pylist() for c in batch.columns))])
    assert found[0] == found[1] and len(found[0]) == 600


def test_all_sources_are_taken(spark):
    """The full measure, stored and counted, equals that of the paths by joins with every vertex a source."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(90, 2))
    ends = {(i, int(j)) for i in range(80) for j in rng.integers(0, 80, 3) if i != j} | {(85, 86)}  # two components, some alone
    edges = spark.createDataFrame([(i, j, float(rng.random())) for i, j in sorted(ends)], "src long, dst long, w double")
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, features array<double>")
    want = geodesic.geodesic_correlation(edges, points, spark.range(90)).first()
    assert geodesic.full_geodesic_correlation(edges, points).first() == want
    found = geodesic.full_geodesic_correlation(edges, points, 3, stored=10, size=1 << 19).first()
    assert found.n_pairs == want.n_pairs == 80 * 79 / 2 + 1 and round(found.rho, 3) == round(want.rho, 3)


def test_the_registered_measure_has_no_sample(spark, sf):
    from fieldweave.plans import registry

    n = registry.points(spark, sf).count()
    full = geodesic.geodesic_correlation(registry._lengths(spark, sf), registry.projected(spark, sf), registry.points(spark, sf).select("id")).first()
    found = registry.queries()["geodesic_correlation"](spark, sf).first()
    assert found.n_pairs == full.n_pairs > 16 * n and found.rho == round(full.rho, 6)
