"""Registered queries of the engine and their DuckDB twins."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions import columns, schedules
from fieldweave.operators import approximate, bootstrap, connected, deltas, descent, evaluation, exact, field, geodesic, graph, local, matching, mesh, optimisers, quality, spectral, stability, svd, targets, topology
from fieldweave.operators.layout import FieldLayout
from fieldweave.operators.neighbors import knn
from fieldweave.operators.saving import saved, shared_folder
from fieldweave.plans.reports import PLANS, spark_text

K = 15


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plan(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(spark_text(text), **{t: _table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two coordinates, as an embedding to judge."""
    return points(spark, sf_dir).select("id", F.slice("features", 1, 2).alias("features"))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("features").cast("array<double>")
    return points(spark, sf_dir).select("id", (f[0] * 20).alias("x"), (f[1] * 20).alias("y"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour edges with the weight 1 / (1 + distance); a checkpoint, as loops and several uses read them again."""
    return saved(knn(points(spark, sf_dir), K).select("src", "dst", (1 / (1 + F.col("dist"))).alias("w")))


def other_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("features").cast("array<double>")
    return points(spark, sf_dir).select("id", f[2].alias("x"), f[3].alias("y"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(knn(points(spark, sf_dir), 5).select("src", "dst", F.col("dist").alias("w")))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select(F.col("quality").cast("long").alias("a"), F.col("toxic").cast("long").alias("b"))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _triplets(spark, sf_dir):
    n = points(spark, sf_dir).count()
    a = F.col("id")
    each = points(spark, sf_dir).select(a.alias("a"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("s"))
    return each.select((F.col("a") * 20 + F.col("s")).alias("t"), "a", ((F.col("a") + F.col("s")) % n).alias("i"), ((F.col("a") + 3 * F.col("s") + 50) % n).alias("j")).filter("i <> j AND a <> i AND a <> j")


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse table: quantities by order and line number."""
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").cast("double").alias("value"))


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures at once, from neighbour tables that they share."""
    store = evaluation.Store(spark, shared_folder(spark, "evaluation"))
    found = evaluation.evaluate(store, points(spark, sf_dir), projected(spark, sf_dir), K, n_triplets=5)
    return _rounded(found.select("n", "preservation", "trustworthiness", "continuity", "distance_rho"), "preservation", "trustworthiness", "continuity", "distance_rho")


def _normalised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by supplier and part, normalised by supplier and logged."""
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").cast("double").alias("value"))
    return columns.normalize_log1p(rows).select("row", F.col("feature").alias("col"), "value")


def _reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table again, from as many components as it has columns."""
    features, _, loadings = svd.truncated_svd(_quantities(spark, sf_dir), 7, power=0)
    return _rounded(svd.reconstructed(_quantities(spark, sf_dir), features, loadings), "value", digits=3)


def _run_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders against others by segment: medians of price and of the customer's balance over five repeats."""
    runs = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    price, balance = (F.struct(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value")) for name, column in (("price", "o_totalprice"), ("balance", "c_acctbal")))
    rows = runs.select(F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("algorithm"), (F.col("o_orderkey") % 5).alias("repeat"), F.explode(F.array(price, balance)).alias("m"))
    found = deltas.paired_deltas(rows.select("dataset", "algorithm", "repeat", "m.*"), [("low", "1-URGENT", "5-LOW"), ("medium", "1-URGENT", "3-MEDIUM")], list(range(5)))
    return _rounded(found, "candidate_value", "baseline_value", "paired_delta", digits=4)


def _target_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh of order 3 against the exact field, at the targets."""
    at = layout(spark, sf_dir)
    chosen = saved(targets.select_targets(at, edges(spark, sf_dir), 100, 20))
    return targets.error_rows(exact.exact_repulsion(at, of=chosen), mesh.mesh_force(at, 32, 3), chosen)


QUERIES = {
    "knn": lambda s, d: _rounded(knn(points(s, d), K), "dist"),
    "knn_manhattan": lambda s, d: _rounded(knn(points(s, d), 5, "manhattan"), "dist"),
    "neighborhood_preservation": lambda s, d: _rounded(quality.neighborhood_preservation(points(s, d), projected(s, d), K), "score", "low", "high"),
    "trustworthiness": lambda s, d: _rounded(quality.trustworthiness(points(s, d), projected(s, d)), "score"),
    "continuity": lambda s, d: _rounded(quality.continuity(points(s, d), projected(s, d)), "score"),
    "distance_spearman": lambda s, d: _rounded(quality.distance_spearman(points(s, d), projected(s, d)), "rho"),
    "triplet_accuracy": lambda s, d: _rounded(quality.triplet_accuracy(_triplets(s, d), points(s, d), projected(s, d)), "accuracy"),
    "adjusted_rand": lambda s, d: _rounded(quality.adjusted_rand(_table(s, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))), "ari"),
    "symmetric_min": lambda s, d: _rounded(graph.symmetric_min(edges(s, d)), "w"),
    "symmetric_max": lambda s, d: _rounded(graph.symmetric_max(edges(s, d)), "w"),
    "fuzzy_graph": lambda s, d: _rounded(graph.fuzzy_weights(knn(points(s, d), K)), "w", digits=4),
    "prune": lambda s, d: _rounded(graph.prune(edges(s, d), 2), "w"),
    "degrees": lambda s, d: _rounded(graph.degrees(points(s, d), graph.symmetric_max(edges(s, d))), "degree"),
    "damping": lambda s, d: _rounded(graph.damping(graph.degrees(points(s, d), graph.symmetric_max(edges(s, d)))), "degree", "scale"),
    "sampling_intervals": lambda s, d: _rounded(graph.intervals(edges(s, d), 200), "w", "interval"),
    "sampling_calendar": lambda s, d: graph.calendar(edges(s, d), 20).groupBy("epoch").agg(F.count(F.lit(1)).alias("n_due"), F.count_distinct("src").alias("n_rows")),
    "layout_bounds": lambda s, d: _rounded(field.bounds(layout(s, d)), "min_x", "min_y", "max_x", "max_y", "span"),
    "mesh_moments": lambda s, d: _rounded(field.moments(layout(s, d), 16), "sx", "sy"),
    "mesh_repulsion": lambda s, d: _rounded(field.mesh_repulsion(layout(s, d), 16), "fx", "fy", digits=4),
    "mesh_fft": lambda s, d: _rounded(mesh.mesh_force(layout(s, d), 16), "fx", "fy", digits=4),
    "mesh_fft_order_3": lambda s, d: mesh.mesh_force(layout(s, d), 32, 3),
    "approximate_knn": lambda s, d: approximate.approximate_knn(points(s, d), K),
    "attraction": lambda s, d: _rounded(field.attraction(edges(s, d), layout(s, d)), "fx", "fy", digits=4),
    "layout_step": lambda s, d: _rounded(field.step(layout(s, d), edges(s, d), 16, 0.5), "x", "y", digits=3),
    "exact_repulsion": lambda s, d: _rounded(exact.exact_repulsion(layout(s, d)), "fx", "fy", digits=4),
    "expected_repulsion": lambda s, d: _rounded(exact.expected_repulsion(layout(s, d), edges(s, d)), "fx", "fy", digits=4),
    "weighted_attraction": lambda s, d: _rounded(exact.weighted_attraction(edges(s, d), layout(s, d)), "fx", "fy", digits=4),
    "t_repulsion": lambda s, d: _rounded(exact.t_repulsion(layout(s, d)), "fx", "fy", digits=4),
    "edge_bias": lambda s, d: _rounded(exact.edge_bias(graph.symmetric_max(edges(s, d))), "w", "bias"),
    "t_attraction": lambda s, d: _rounded(exact.t_attraction(exact.edge_bias(graph.symmetric_max(edges(s, d))), layout(s, d)), "fx", "fy", digits=4),
    "local_repulsion": lambda s, d: _rounded(local.local_repulsion(layout(s, d), 16, 5, 2.5, least=2, around=True), "fx", "fy", digits=4),
    "local_repulsion_symmetric": lambda s, d: _rounded(local.local_repulsion(layout(s, d), 16, 5, 2.5, symmetric=True), "fx", "fy", digits=4),
    "price_intervals": lambda s, d: bootstrap.intervals(_table(s, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", 200),
    "density_pressure": lambda s, d: _rounded(exact.density_pressure(layout(s, d), 16, 5), "fx", "fy", digits=4),
    "local_radius": lambda s, d: _rounded(exact.local_radius(edges(s, d), layout(s, d)), "radius"),
    "graph_components": lambda s, d: connected.components(points(s, d).select("id"), knn(points(s, d), 2).select("src", "dst", F.col("dist").alias("w"))),
    "geodesic_correlation": lambda s, d: _rounded(geodesic.full_geodesic_correlation(_lengths(s, d), projected(s, d)), "rho"),
    "adjusted_mutual_information": lambda s, d: s.createDataFrame([(round(matching.adjusted_mutual_information(_labels(s, d)), 6),)], "ami double"),
    "label_changes": lambda s, d: _rounded(matching.label_changes(_labels(s, d)), "changed", "noise_flips", "between_clusters"),
    "procrustes": lambda s, d: _rounded(stability.procrustes(layout(s, d), other_layout(s, d)).select("rms", "n"), "rms"),
    "neighbour_overlap": lambda s, d: _rounded(stability.neighbour_overlap(points(s, d), projected(s, d), K), "overlap"),
    "arc_positions": lambda s, d: _rounded(stability.arc_positions(layout(s, d)), "arc", digits=4),
    "pseudotime_correlation": lambda s, d: _rounded(stability.pseudotime_correlation(layout(s, d), points(s, d).select("id", F.col("id").cast("double").alias("t"))), "rho"),
    "cell_similarity": lambda s, d: _rounded(stability.cell_similarity(points(s, d), projected(s, d)), "rho", digits=4),
    "pseudotime_pearson": lambda s, d: _rounded(stability.pseudotime_correlation(layout(s, d), points(s, d).select("id", F.col("id").cast("double").alias("t")), "pearson"), "rho"),
    "norm_statistics": lambda s, d: _rounded(columns.norm_statistics(layout(s, d).select(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2).alias("r")), "r", "r", (2.0, 4.5)), "r_max", "r_mean", "r_p95", "r_p99", "r_p999", "r_gt_2_pct", "r_gt_4p5_pct"),
    "core_shape": lambda s, d: _rounded(field.core_shape(layout(s, d), 0.9), "width", "height", "core_width", "core_height", "core_radius", "radius_max", "area_ratio", "extent_ratio", "far_pct"),
    "total_clip": lambda s, d: _rounded(field.clip_total(field.attraction(edges(s, d), layout(s, d)), field.mesh_repulsion(layout(s, d), 16), 4.0), "ax", "ay", "rx", "ry", "norm", digits=3),
    "name_tokens": lambda s, d: _table(s, d, "part").select("p_partkey", columns.normalized_token(F.col("p_name")).alias("token")),
    "lenient_truth": lambda s, d: _table(s, d, "part").select("p_partkey", columns.as_bool(F.col("p_retailprice") / 1000, "double").alias("dear"), columns.as_bool(F.col("p_size") % 2, "int").alias("odd"), columns.as_bool(F.concat(F.lit(" "), (F.col("p_size") % 3).cast("string")), "string").alias("one"), columns.is_informative(F.when(F.col("p_size") % 5 == 0, F.lit(" Not Provided")).otherwise(F.col("p_brand"))).alias("told")),
    "label_codes": lambda s, d: columns.encoded(_table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment"),
    "quantized_layout": lambda s, d: columns.quantized(layout(s, d), 1023),
    "normalize_log1p": lambda s, d: _rounded(columns.normalize_log1p(_table(s, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("feature"), F.col("l_quantity").alias("value"))).groupBy("row").agg(F.sum("value").alias("value")), "value"),
    "svd_reconstruction": _reconstruction,
    "svd_features": lambda s, d: svd.truncated_svd(_normalised_counts(s, d), 16)[0],
    "evaluation": _evaluation,
    "reliability": lambda s, d: evaluation.reliability_by_permutation(points(s, d), lambda p: p.select("id", F.slice("features", 1, 2).alias("features"))),
    "persistent_homology": lambda s, d: s.createDataFrame([topology.persistent_homology_distance(points(s, d), projected(s, d), 24)], "h0 double, h1 double, total double"),
    "spectral_layout": lambda s, d: spectral.spectral_init(points(s, d).select("id"), edges(s, d), points(s, d)),
    "field_layout": lambda s, d: FieldLayout(n_epochs=schedules.default_epochs(points(s, d).count())).fit_transform(points(s, d)),
    "field_targets": lambda s, d: targets.select_targets(layout(s, d), edges(s, d), 100, 20),
    "target_errors": _target_errors,
    "stability_deltas": _run_deltas,
    "sampled_layout": lambda s, d: optimisers.sampled_layout(edges(s, d), layout(s, d), 4),
    "asynchronous_layout": lambda s, d: descent.asynchronous_layout(graph.symmetric_max(edges(s, d)), layout(s, d), 10, rows=2048),
    "t_layout": lambda s, d: optimisers.t_layout(edges(s, d), layout(s, d), 3),
}

_P = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings)"
_E = "e AS (SELECT vec_id AS id, embedding[1:2]::DOUBLE[] AS f FROM embeddings)"
_D = "list_distance(a.f, b.f)"


def _knn_sql(name: str, of: str, k: int, dist: str = _D) -> str:
    return f"{name} AS (SELECT src, dst, rank, dist FROM (SELECT a.id AS src, b.id AS dst, {dist} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {dist}, b.id) AS rank FROM {of} a JOIN {of} b ON a.id <> b.id) WHERE rank <= {k})"


_EDGES = f"{_P}, {_knn_sql('k', 'p', K)}, g AS (SELECT src, dst, 1 / (1 + dist) AS w FROM k)"
_MAX = "m AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g) GROUP BY src, dst)"
_DEG = f"{_EDGES}, {_MAX}, d AS (SELECT p.id, coalesce(sum(w), 0.0) AS degree FROM p LEFT JOIN m ON m.src = p.id GROUP BY p.id)"
_L = "l AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y FROM embeddings)"
_CELL = f"{_L}, b AS (SELECT least(min(x), min(y)) AS low, (greatest(max(x), max(y)) - least(min(x), min(y))) / 16 AS width FROM l), c AS (SELECT id, x, y, width, least(floor((x - low) / width), 15)::INT AS cx, least(floor((y - low) / width), 15)::INT AS cy FROM l, b)"
_FIELD = "m2 AS (SELECT cx, cy, any_value(width) AS width, sum(x) AS sx, sum(y) AS sy, count(*) AS cnt FROM c GROUP BY cx, cy), q AS (SELECT s.cx, s.cy, least(4.0, 2 * 0.895 / ((0.001 + r2) * (1 + 1.577 * pow(r2, 0.895)))) AS k, o_sx, o_sy, o_cnt FROM (SELECT s.cx, s.cy, t.sx AS o_sx, t.sy AS o_sy, t.cnt AS o_cnt, pow((s.cx - t.cx) * s.width, 2) + pow((s.cy - t.cy) * s.width, 2) AS r2 FROM m2 s, m2 t) s), h AS (SELECT cx, cy, sum(k * o_cnt) AS phi, sum(k * o_sx) AS px, sum(k * o_sy) AS py FROM q GROUP BY cx, cy), push AS (SELECT id, phi * x - px AS fx, phi * y - py AS fy FROM c JOIN h USING (cx, cy))"
_PULL = "z AS (SELECT src, s.x - t.x AS dx, s.y - t.y AS dy FROM g JOIN l s ON s.id = src JOIN l t ON t.id = dst), z2 AS (SELECT src, dx, dy, CASE WHEN dx * dx + dy * dy > 0 THEN -2 * 1.577 * 0.895 * pow(dx * dx + dy * dy, 0.895 - 1) / (1 + 1.577 * pow(dx * dx + dy * dy, 0.895)) ELSE 0 END AS gr FROM z), pull AS (SELECT src AS id, sum(greatest(-4.0, least(4.0, gr * dx))) AS fx, sum(greatest(-4.0, least(4.0, gr * dy))) AS fy FROM z2 GROUP BY src)"

_ALL = "z AS (SELECT a.id, b.id AS other, a.x - b.x AS dx, a.y - b.y AS dy, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS r2 FROM l a, l b)"
_TARGETS = f"""WITH {_EDGES}, {_L}, v AS (SELECT l.id, x, y, x - median(x) OVER () AS u, y - median(y) OVER () AS w FROM l),
    d AS (SELECT src AS id, sum(w) AS degree FROM g GROUP BY src),
    r AS (SELECT id, max(dist) AS reach FROM (SELECT a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS rank FROM l a JOIN l b ON a.id <> b.id) WHERE rank <= 7 GROUP BY id),
    chosen AS (SELECT 'random' AS target_group, id, row_number() OVER (ORDER BY md5('0:' || id), id) - 1 AS place, 100 AS most FROM l
        UNION ALL SELECT 'high_degree', l.id, row_number() OVER (ORDER BY coalesce(degree, 0) DESC, l.id) - 1, 20 FROM l LEFT JOIN d USING (id)
        UNION ALL SELECT 'dense_region', id, row_number() OVER (ORDER BY reach, id) - 1, 20 FROM r
        UNION ALL SELECT 'radial_tail', id, row_number() OVER (ORDER BY sqrt(u * u + w * w) DESC, id) - 1, 20 FROM v)
    SELECT target_group, place::INT AS place, id FROM chosen WHERE place < most"""
_BIAS = "o AS (SELECT src AS v, count(*) AS n FROM m GROUP BY src), e AS (SELECT src, dst, w, t.n / (s.n + t.n) AS bias FROM m JOIN o s ON s.v = src JOIN o t ON t.v = dst)"
_ARC = "s AS (SELECT avg(x) AS mx, avg(y) AS my, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS t FROM l), o AS (SELECT id, x, y, (x - mx) * cos(t) + (y - my) * sin(t) AS p FROM l, s), d AS (SELECT id, p, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS gap FROM o WINDOW w AS (ORDER BY p, id)), arc AS (SELECT id, sum(gap) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING) AS arc FROM d)"


def _rank_sql(near: str, ranked: str) -> str:
    return f"WITH {_P}, {_E}, {_knn_sql('k', near, 5)}, r AS (SELECT k.src, k.dst, 1 + (SELECT count(*) FROM {ranked} o WHERE o.id <> k.src AND list_distance(o.f, s.f) < list_distance(t.f, s.f)) AS rank FROM k JOIN {ranked} s ON s.id = k.src JOIN {ranked} t ON t.id = k.dst), n AS (SELECT count(*)::DOUBLE AS n FROM p) SELECT round(1 - 2.0 / (any_value(n) * 5 * (2 * any_value(n) - 16)) * sum(greatest(rank - 5, 0)), 6) AS score FROM r, n"


ORACLE = {
    "knn": f"WITH {_P}, {_knn_sql('k', 'p', K)} SELECT src, dst, rank, round(dist, 6) AS dist FROM k",
    "knn_manhattan": f"WITH {_P}, {_knn_sql('k', 'p', 5, 'list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2])))')} SELECT src, dst, rank, round(dist, 6) AS dist FROM k",
    "neighborhood_preservation": f"WITH {_P}, {_E}, {_knn_sql('k', 'p', K)}, {_knn_sql('q', 'e', K)}, s AS (SELECT src, count(*) / {K} AS s FROM k JOIN q USING (src, dst) GROUP BY src), x AS (SELECT coalesce(s, 0.0) AS s FROM p LEFT JOIN s ON src = id) SELECT round(avg(s), 6) AS score, round(min(s), 6) AS low, round(max(s), 6) AS high, count(*) AS n FROM x",
    "trustworthiness": _rank_sql("e", "p"),
    "continuity": _rank_sql("p", "e"),
    "distance_spearman": f"WITH {_P}, {_E}, x AS (SELECT a.id AS i, b.id AS j, {_D} AS x FROM p a JOIN p b ON a.id < b.id), y AS (SELECT a.id AS i, b.id AS j, {_D} AS y FROM e a JOIN e b ON a.id < b.id), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM x JOIN y USING (i, j)) SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n_pairs FROM r",
    "triplet_accuracy": f"WITH {_P}, {_E}, n AS (SELECT count(*) AS n FROM p), t AS (SELECT id AS a, (id + s) % n AS i, (id + 3 * s + 50) % n AS j FROM p, n, range(1, 21) AS r(s)), u AS (SELECT sign(list_distance(pa.f, pi.f) - list_distance(pa.f, pj.f)) AS s, sign(list_distance(ea.f, ei.f) - list_distance(ea.f, ej.f)) AS e FROM t JOIN p pa ON pa.id = a JOIN p pi ON pi.id = i JOIN p pj ON pj.id = j JOIN e ea ON ea.id = a JOIN e ei ON ei.id = i JOIN e ej ON ej.id = j WHERE i <> j AND a <> i AND a <> j) SELECT round(avg((s = e)::INT), 6) AS accuracy, count(*) AS n_used, count(*) FILTER (e = 0) AS n_embedded_ties FROM u WHERE s <> 0",
    "adjusted_rand": "WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n) * (sum(n) - 1) / 2 AS m FROM c), r AS (SELECT sum(n * (n - 1) / 2) AS ra FROM (SELECT sum(n) AS n FROM c GROUP BY a)), s AS (SELECT sum(n * (n - 1) / 2) AS rb FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((c - ra * rb / m) / ((ra + rb) / 2 - ra * rb / m), 6) AS ari FROM t, r, s",
    "symmetric_min": f"WITH {_EDGES} SELECT src, dst, round(min(w), 6) AS w FROM (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g) GROUP BY src, dst",
    "symmetric_max": f"WITH {_EDGES}, {_MAX} SELECT src, dst, round(w, 6) AS w FROM m",
    "prune": f"WITH {_EDGES} SELECT src, dst, round(w, 6) AS w FROM g WHERE w >= (SELECT max(w) FROM g) / 2",
    "degrees": f"WITH {_DEG} SELECT id, round(degree, 6) AS degree FROM d",
    "damping": f"WITH {_DEG}, q AS (SELECT quantile_cont(degree, 0.99) AS ref FROM d) SELECT id, round(degree, 6) AS degree, round(CASE WHEN degree > 0 THEN least(1.0, pow(ref / degree, 0.5)) ELSE 1.0 END, 6) AS scale FROM d, q",
    "sampling_intervals": f"WITH {_EDGES} SELECT src, dst, round(w, 6) AS w, round(200 / (200 * w / (SELECT max(w) FROM g)), 6) AS interval FROM g",
    "sampling_calendar": f"WITH {_EDGES}, v AS (SELECT src, dst, 20 / (20 * w / (SELECT max(w) FROM g)) AS i FROM g), x AS (SELECT DISTINCT ceil(r * i)::INT AS epoch, src, dst FROM v, range(1, 20) AS t(r) WHERE r <= floor(19 / i) AND ceil(r * i) < 20) SELECT epoch, count(*) AS n_due, count(DISTINCT src) AS n_rows FROM x GROUP BY epoch",
    "layout_bounds": f"WITH {_L} SELECT round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(greatest(max(x), max(y)) - least(min(x), min(y)), 6) AS span, count(*) FILTER (NOT isfinite(x) OR NOT isfinite(y)) AS n_bad FROM l",
    "mesh_moments": f"WITH {_CELL} SELECT cx, cy, round(sum(x), 6) AS sx, round(sum(y), 6) AS sy, count(*) AS cnt FROM c GROUP BY cx, cy",
    "mesh_repulsion": f"WITH {_CELL}, {_FIELD} SELECT id, round(fx, 4) AS fx, round(fy, 4) AS fy FROM push",
    "mesh_fft": f"WITH {_CELL}, {_FIELD} SELECT id, round(fx, 4) AS fx, round(fy, 4) AS fy FROM push",
    "attraction": f"WITH {_EDGES}, {_L}, {_PULL} SELECT id, round(fx, 4) AS fx, round(fy, 4) AS fy FROM pull",
    "layout_step": f"WITH {_EDGES}, {_CELL}, {_PULL}, {_FIELD}, cl AS (SELECT id, CASE WHEN sqrt(fx * fx + fy * fy) > 4 THEN 4 / sqrt(fx * fx + fy * fy) ELSE 1 END AS f, fx, fy FROM push) SELECT l.id, round(l.x + 0.5 * (coalesce(pull.fx, 0) + coalesce(cl.fx * f, 0)), 3) AS x, round(l.y + 0.5 * (coalesce(pull.fy, 0) + coalesce(cl.fy * f, 0)), 3) AS y FROM l LEFT JOIN pull USING (id) LEFT JOIN cl USING (id)",
    "exact_repulsion": f"WITH {_L}, {_ALL}, x AS (SELECT *, 2 * 0.895 / ((0.001 + r2) * (1 + 1.577 * pow(r2, 0.895))) AS k FROM z) SELECT id, round(sum(greatest(-4.0, least(4.0, k * dx))), 4) AS fx, round(sum(greatest(-4.0, least(4.0, k * dy))), 4) AS fy FROM x GROUP BY id",
    "expected_repulsion": f"WITH {_EDGES}, {_L}, {_ALL}, x AS (SELECT z.*, 1 - coalesce(g.w, 0) AS f, 2 * 0.895 / ((0.001 + r2) * (1 + 1.577 * pow(r2, 0.895))) AS k FROM z LEFT JOIN g ON g.src = z.id AND g.dst = z.other) SELECT id, round(sum(f * greatest(-4.0, least(4.0, k * dx))), 4) AS fx, round(sum(f * greatest(-4.0, least(4.0, k * dy))), 4) AS fy FROM x GROUP BY id",
    "weighted_attraction": f"WITH {_EDGES}, {_L}, {_ALL}, x AS (SELECT z.id, dx, dy, CASE WHEN r2 > 0 THEN g.w * -2 * 1.577 * 0.895 * pow(r2, 0.895 - 1) / (1 + 1.577 * pow(r2, 0.895)) ELSE 0 END AS k FROM z JOIN g ON g.src = z.id AND g.dst = z.other) SELECT id, round(sum(greatest(-4.0, least(4.0, k * dx))), 4) AS fx, round(sum(greatest(-4.0, least(4.0, k * dy))), 4) AS fy FROM x GROUP BY id",
    "t_repulsion": f"WITH {_L}, {_ALL} SELECT id, round(sum(dx / pow(1 + r2, 2)), 4) AS fx, round(sum(dy / pow(1 + r2, 2)), 4) AS fy FROM z GROUP BY id",
    "edge_bias": f"WITH {_EDGES}, {_MAX}, {_BIAS} SELECT src, dst, round(w, 6) AS w, round(bias, 6) AS bias FROM e",
    "t_attraction": f"WITH {_EDGES}, {_MAX}, {_BIAS}, {_L}, {_ALL} SELECT z.id, round(sum((8 / (1 + r2) + bias) * -dx), 4) AS fx, round(sum((8 / (1 + r2) + bias) * -dy), 4) AS fy FROM z JOIN e ON e.src = z.id AND e.dst = z.other GROUP BY z.id",
    "density_pressure": f"WITH {_CELL}, n AS (SELECT cx, cy, count(*) AS n FROM c GROUP BY cx, cy HAVING count(*) > 5) SELECT id, round((n - 5) / n * (x - (low + (cx + 0.5) * c.width)), 4) AS fx, round((n - 5) / n * (y - (low + (cy + 0.5) * c.width)), 4) AS fy FROM c JOIN n USING (cx, cy), b",
    "local_radius": f"WITH {_EDGES}, {_L}, {_ALL} SELECT round(median(sqrt(r2)), 6) AS radius FROM z JOIN g ON g.src = z.id AND g.dst = z.other WHERE r2 > 0",
    "graph_components": f"WITH RECURSIVE {_P}, {_knn_sql('k', 'p', 2)}, m AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k), r AS (SELECT id, id AS c FROM p UNION SELECT m.src, r.c FROM r JOIN m ON m.dst = r.id) SELECT id, min(c) AS component FROM r GROUP BY id",
    "adjusted_mutual_information": "WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), a AS (SELECT a, sum(n) AS n FROM c GROUP BY a), b AS (SELECT b, sum(n) AS n FROM c GROUP BY b), mi AS (SELECT sum(c.n / t * ln(c.n * t / (a.n * b.n))) AS mi FROM c JOIN a USING (a) JOIN b USING (b), t), h AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM a, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM b, t) AS hb), x AS (SELECT a.n AS x, b.n AS y, t, unnest(range(greatest(1, a.n + b.n - t)::BIGINT, least(a.n, b.n)::BIGINT + 1)) AS n FROM a, b, t), e AS (SELECT sum(n / t * ln(n * t / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(x - n + 1) - lgamma(y - n + 1) - lgamma(t - x - y + n + 1))) AS e FROM x) SELECT round((mi - e) / ((ha + hb) / 2 - e), 6) AS ami FROM mi, h, e",
    # two labels without noise: they keep their names or swap
    "field_targets": _TARGETS,
    "stability_deltas": "WITH r AS (SELECT c_mktsegment AS dataset, o_orderpriority AS algorithm, unnest([{'metric': 'price', 'value': o_totalprice::DOUBLE}, {'metric': 'balance', 'value': c_acctbal::DOUBLE}]) AS m FROM orders JOIN customer ON o_custkey = c_custkey), v AS (SELECT dataset, algorithm, m.metric AS metric, median(m.value) AS v FROM r GROUP BY ALL) SELECT CASE b.algorithm WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS comparison, c.dataset, c.metric, round(c.v, 4) AS candidate_value, round(b.v, 4) AS baseline_value, round(c.v - b.v, 4) AS paired_delta FROM v c JOIN v b ON c.dataset = b.dataset AND c.metric = b.metric WHERE c.algorithm = '1-URGENT' AND b.algorithm IN ('5-LOW', '3-MEDIUM')",
    "label_changes": "WITH s AS (SELECT avg((quality <> toxic)::INT::DOUBLE) AS c, count(*) AS n FROM labels) SELECT round(least(c, 1 - c), 6) AS changed, 0.0::DOUBLE AS noise_flips, round(least(c, 1 - c), 6) AS between_clusters, n FROM s",
    # the best orthogonal map leaves 2 - 2 (sum of singular values) of the squared gap
    "procrustes": "WITH l AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings), m AS (SELECT covar_pop(a, c) AS ac, covar_pop(a, d) AS ad, covar_pop(b, c) AS bc, covar_pop(b, d) AS bd, sqrt((var_pop(a) + var_pop(b)) * (var_pop(c) + var_pop(d))) AS f, count(*) AS n FROM l) SELECT round(sqrt((2 - 2 / f * greatest(sqrt(pow(ac + bd, 2) + pow(ad - bc, 2)), sqrt(pow(ac - bd, 2) + pow(ad + bc, 2)))) / n), 6) AS rms, n FROM m",
    "neighbour_overlap": f"WITH {_P}, {_E}, {_knn_sql('k', 'p', K)}, {_knn_sql('q', 'e', K)} SELECT round((SELECT count(*) FROM k JOIN q USING (src, dst)) / count(*) / {K}, 6) AS overlap, count(*) AS n FROM p",
    "arc_positions": f"WITH {_L}, {_ARC} SELECT id, round(arc, 4) AS arc FROM arc",
    "pseudotime_correlation": f"WITH {_L}, {_ARC}, r AS (SELECT rank() OVER (ORDER BY arc) + (count(*) OVER (PARTITION BY arc) - 1) / 2 AS a, rank() OVER (ORDER BY id) AS b FROM arc) SELECT round(abs(corr(a, b)), 6) AS rho, count(*) AS n FROM r",
    "cell_similarity": f"WITH {_P}, {_E}, {_knn_sql('k', 'p', 1000000)}, {_knn_sql('q', 'e', 1000000)}, h AS (SELECT count(*) // 2 AS h FROM p) SELECT k.src, round(corr(a.dist, b.dist), 4) AS rho FROM k JOIN h ON k.rank <= h JOIN q a ON a.src = k.src AND a.dst = k.dst JOIN q b ON b.src = k.src AND b.rank = k.rank GROUP BY k.src",
    "pseudotime_pearson": f"WITH {_L}, {_ARC} SELECT round(abs(corr(arc, id)), 6) AS rho, count(*) AS n FROM arc",
    "norm_statistics": f"WITH {_L}, r AS (SELECT sqrt(x * x + y * y) AS r FROM l) SELECT round(max(r), 6) AS r_max, round(avg(r), 6) AS r_mean, round(quantile_cont(r, 0.95), 6) AS r_p95, round(quantile_cont(r, 0.99), 6) AS r_p99, round(quantile_cont(r, 0.999), 6) AS r_p999, count(*) FILTER (r > 2) AS r_gt_2_count, round(100.0 * avg((r > 2)::INT), 6) AS r_gt_2_pct, count(*) FILTER (r > 4.5) AS r_gt_4p5_count, round(100.0 * avg((r > 4.5)::INT), 6) AS r_gt_4p5_pct FROM r",
    "core_shape": f"WITH {_L}, m AS (SELECT median(x) AS mx, median(y) AS my FROM l), r AS (SELECT x, y, sqrt(pow(x - mx, 2) + pow(y - my, 2)) AS r FROM l, m), k AS (SELECT r.*, row_number() OVER (ORDER BY r) AS place, count(*) OVER () AS n FROM r), c AS (SELECT min(r) AS core_radius FROM k WHERE place = ceil(0.9 * n)), b AS (SELECT max(x) - min(x) AS width, max(y) - min(y) AS height, max(x) FILTER (r <= core_radius) - min(x) FILTER (r <= core_radius) AS core_width, max(y) FILTER (r <= core_radius) - min(y) FILTER (r <= core_radius) AS core_height, any_value(core_radius) AS core_radius, max(r) AS radius_max, count(*) FILTER (r > 2 * core_radius) AS far_count, count(*) AS n FROM k, c) SELECT round(width, 6) AS width, round(height, 6) AS height, round(core_width, 6) AS core_width, round(core_height, 6) AS core_height, round(core_radius, 6) AS core_radius, round(radius_max, 6) AS radius_max, far_count, n, round(width * height / (core_width * core_height), 6) AS area_ratio, round(greatest(width / core_width, height / core_height), 6) AS extent_ratio, round(100.0 * far_count / n, 6) AS far_pct FROM b",
    "total_clip": f"WITH {_EDGES}, {_CELL}, {_PULL}, {_FIELD}, t AS (SELECT id, coalesce(pull.fx, 0) AS ax, coalesce(pull.fy, 0) AS ay, coalesce(push.fx, 0) AS rx, coalesce(push.fy, 0) AS ry FROM pull FULL JOIN push USING (id)), u AS (SELECT *, sqrt(pow(ax + rx, 2) + pow(ay + ry, 2)) AS norm FROM t), v AS (SELECT *, least(1.0, 4 / (norm + 1e-12)) AS f FROM u) SELECT id, round(ax * f, 3) AS ax, round(ay * f, 3) AS ay, round(rx * f, 3) AS rx, round(ry * f, 3) AS ry, round(norm, 3) AS norm FROM v",
    "name_tokens": "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS token FROM part",
    "lenient_truth": "SELECT p_partkey, trunc(p_retailprice / 1000) <> 0 AS dear, p_size % 2 <> 0 AS odd, p_size % 3 = 1 AS one, p_size % 5 <> 0 AS told FROM part",
    "label_codes": "SELECT c_custkey, c_mktsegment, (SELECT count(DISTINCT o.c_mktsegment) FROM customer o WHERE o.c_mktsegment < c.c_mktsegment)::INT AS code FROM customer c",
    "quantized_layout": f"WITH {_L}, b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS span FROM l) SELECT id, round_even((x - x0) * (1023 / span), 0)::INT AS qx, round_even((y - y0) * (1023 / span), 0)::INT AS qy FROM l, b",
    "normalize_log1p": "WITH s AS (SELECT l_orderkey AS row, sum(l_quantity) AS total FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 0), t AS (SELECT median(total) AS target FROM s) SELECT row, round(sum(ln(1 + l_quantity * target / total)), 6) AS value FROM lineitem JOIN s ON row = l_orderkey, t GROUP BY row",
}

ORACLE["evaluation"] = "SELECT (SELECT count(*) FROM embeddings) AS n, " + ", ".join(
    f"(SELECT {c} FROM ({ORACLE[name]})) AS {out}" for out, name, c in (("preservation", "neighborhood_preservation", "score"), ("trustworthiness", "trustworthiness", "score"), ("continuity", "continuity", "score"), ("distance_rho", "distance_spearman", "rho"))
)
_LOCAL = "u AS (SELECT a.id, b.id AS other, a.x - b.x AS dx, a.y - b.y AS dy, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS r2 FROM c a JOIN c b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND a.id <> b.id {only}), v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r2, other) AS place FROM u WHERE r2 > 0 AND r2 <= 6.25), w AS (SELECT *, 2 * 0.895 / ((0.001 + r2) * (1 + 1.577 * pow(r2, 0.895))) AS k FROM v WHERE place <= 5), f AS (SELECT id, other, greatest(-4.0, least(4.0, k * dx)) AS gx, greatest(-4.0, least(4.0, k * dy)) AS gy FROM w)"
_CROWDED = "n1 AS (SELECT cx, cy, count(*) AS n FROM c GROUP BY cx, cy), n9 AS (SELECT a.cx, a.cy, sum(b.n) AS n FROM n1 a JOIN n1 b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY a.cx, a.cy)"
ORACLE["local_repulsion"] = f"WITH {_CELL}, {_CROWDED}, {_LOCAL.format(only='AND EXISTS (SELECT 1 FROM n9 WHERE n9.cx = a.cx AND n9.cy = a.cy AND n9.n >= 2)')} SELECT id, round(sum(gx), 4) AS fx, round(sum(gy), 4) AS fy FROM f GROUP BY id"
ORACLE["local_repulsion_symmetric"] = f"WITH {_CELL}, {_LOCAL.format(only='AND b.id > a.id')}, g AS (SELECT id, gx, gy FROM f UNION ALL SELECT other, -gx, -gy FROM f) SELECT id, round(sum(gx), 4) AS fx, round(sum(gy), 4) AS fy FROM g GROUP BY id"
ORACLE["svd_reconstruction"] = "SELECT l_orderkey AS row, l_linenumber::BIGINT AS col, round(sum(l_quantity)::DOUBLE, 3) AS value FROM lineitem GROUP BY ALL HAVING sum(l_quantity) <> 0"


def queries():
    return QUERIES | {name: partial(_plan, text) for name, text in PLANS.items()}


def oracle_sql():
    return ORACLE | {name: re.sub(r"\{(\w+)\}", r"\1", text) for name, text in PLANS.items()}
