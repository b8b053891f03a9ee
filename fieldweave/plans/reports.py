"""Reporting plans over run records, stage logs and dataset tables, as SQL that needs no dialect.

Run records are orders with their customers: the market segment is the dataset, the priority the
algorithm, the status the profile, the price the run time and orderkey % 5 the repeat. Braces name
tables. Each plan is one declarative statement; joins, aggregates and windows are Catalyst's.
"""

RUNS = "(SELECT o_orderkey AS run_id, c_mktsegment AS dataset, o_orderpriority AS algorithm, o_orderstatus AS profile, o_totalprice AS seconds, o_orderkey % 5 AS repeat, c_nationkey AS device FROM {orders} JOIN {customer} ON o_custkey = c_custkey)"
_stats = "count(*) AS n, round(avg(seconds), 4) AS mean, round(coalesce(stddev_samp(seconds), 0e0), 4) AS sd, round(median(seconds), 4) AS median, round(min(seconds), 4) AS low, round(max(seconds), 4) AS high, round(CASE WHEN avg(seconds) = 0 THEN 0e0 ELSE coalesce(stddev_samp(seconds), 0e0) / avg(seconds) END, 6) AS cv"

PLANS = {
    # two grouping levels in one pass
    "grouped_summary": f"SELECT coalesce(dataset, '__all__') AS dataset, algorithm, profile, {_stats} FROM {RUNS} AS r GROUP BY GROUPING SETS ((dataset, algorithm, profile), (algorithm, profile))",
    "dataset_summary": f"SELECT dataset, count(*) AS n, sum(CASE WHEN profile = 'O' THEN 1 ELSE 0 END) AS n_open, sum(CASE WHEN profile = 'F' THEN 1 ELSE 0 END) AS n_done, sum(CASE WHEN profile NOT IN ('O', 'F') THEN 1 ELSE 0 END) AS n_other FROM {RUNS} AS r GROUP BY dataset",
    # candidate against every baseline of the same dataset, profile and repeat
    "paired_speedup": f"""WITH m AS (SELECT dataset, profile, repeat, algorithm, median(seconds) AS seconds FROM {RUNS} AS r GROUP BY dataset, profile, repeat, algorithm)
        SELECT c.dataset, c.profile, c.repeat, b.algorithm AS baseline, round(b.seconds, 4) AS baseline_s, round(c.seconds, 4) AS candidate_s, round(b.seconds / c.seconds, 6) AS speedup, round(c.seconds - b.seconds, 4) AS delta
        FROM m c JOIN m b ON c.dataset = b.dataset AND c.profile = b.profile AND c.repeat = b.repeat WHERE c.algorithm = '1-URGENT' AND b.algorithm <> '1-URGENT'""",
    "paired_quality": f"""WITH m AS (SELECT dataset, profile, repeat, algorithm, avg(seconds) AS v FROM {RUNS} AS r GROUP BY dataset, profile, repeat, algorithm)
        SELECT c.dataset, c.profile, c.repeat, b.algorithm AS baseline, round(c.v - b.v, 4) AS improvement, CASE WHEN c.v - b.v > 1e-6 THEN 'win' WHEN c.v - b.v < -1e-6 THEN 'loss' ELSE 'tie' END AS outcome
        FROM m c JOIN m b ON c.dataset = b.dataset AND c.profile = b.profile AND c.repeat = b.repeat WHERE c.algorithm = '1-URGENT' AND b.algorithm <> '1-URGENT'""",
    "win_loss": f"""WITH m AS (SELECT dataset, profile, repeat, algorithm, avg(seconds) AS v FROM {RUNS} AS r GROUP BY dataset, profile, repeat, algorithm)
        SELECT c.profile, b.algorithm AS baseline, sum(CASE WHEN c.v - b.v > 1e-6 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN c.v - b.v < -1e-6 THEN 1 ELSE 0 END) AS losses, sum(CASE WHEN c.v > b.v THEN 1 WHEN c.v < b.v THEN -1 ELSE 0 END) AS balance
        FROM m c JOIN m b ON c.dataset = b.dataset AND c.profile = b.profile AND c.repeat = b.repeat WHERE c.algorithm = '1-URGENT' AND b.algorithm <> '1-URGENT' GROUP BY c.profile, b.algorithm""",
    # ties share their mean rank; the direction of the metric is up
    "average_rank": f"""WITH m AS (SELECT dataset, profile, repeat, algorithm, round(avg(seconds), -3) AS v FROM {RUNS} AS r GROUP BY dataset, profile, repeat, algorithm),
        k AS (SELECT *, rank() OVER (PARTITION BY dataset, profile, repeat ORDER BY v DESC) + (count(*) OVER (PARTITION BY dataset, profile, repeat, v) - 1) / 2e0 AS place FROM m)
        SELECT algorithm, profile, round(avg(place), 6) AS mean_rank, count(*) AS n FROM k GROUP BY algorithm, profile""",
    "runtime_cv": f"WITH m AS (SELECT dataset, algorithm, stddev_samp(seconds) / avg(seconds) AS cv FROM {RUNS} AS r GROUP BY dataset, algorithm) SELECT algorithm, round(median(cv), 6) AS cv FROM m GROUP BY algorithm",
    "scaling": f"SELECT dataset, algorithm, count(*) AS n_rows, round(median(seconds), 4) AS median_s FROM {RUNS} AS r WHERE profile = 'O' GROUP BY dataset, algorithm",
    "profile_delta": f"SELECT dataset, algorithm, round(median(CASE WHEN profile = 'O' THEN seconds END), 4) AS open_s, round(median(CASE WHEN profile = 'F' THEN seconds END), 4) AS done_s, round(median(CASE WHEN profile = 'O' THEN seconds END) / median(CASE WHEN profile = 'F' THEN seconds END), 6) AS ratio FROM {RUNS} AS r GROUP BY dataset, algorithm",
    "failure_rate": f"SELECT dataset, algorithm, round(avg(CASE WHEN profile = 'P' THEN 1e0 ELSE 0e0 END), 6) AS failed FROM {RUNS} AS r GROUP BY dataset, algorithm",
    "size_bins": "SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'middle' ELSE 'large' END AS bin, count(*) AS n, round(median(o_totalprice), 4) AS median_price, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY 1",
    "nested_means": f"WITH d AS (SELECT dataset, algorithm, repeat, avg(seconds) AS v FROM {RUNS} AS r GROUP BY dataset, algorithm, repeat), f AS (SELECT dataset, algorithm, avg(v) AS v FROM d GROUP BY dataset, algorithm) SELECT algorithm, round(avg(v), 4) AS overall, round(min(v), 4) AS low, round(max(v), 4) AS high FROM f GROUP BY algorithm",
    "quality_pareto": f"WITH q AS (SELECT l_orderkey AS run_id, avg(l_discount) AS quality FROM {{lineitem}} GROUP BY l_orderkey) SELECT r.algorithm, r.dataset, round(median(q.quality), 6) AS quality, round(median(r.seconds), 4) AS seconds, count(*) AS n FROM q JOIN {RUNS} AS r ON q.run_id = r.run_id GROUP BY r.algorithm, r.dataset",
    "skip_rule_ratio": f"WITH s AS (SELECT DISTINCT dataset FROM {RUNS} AS r0 WHERE dataset = 'MACHINERY'), m AS (SELECT r.dataset, r.algorithm, median(r.seconds) AS v FROM {RUNS} AS r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.dataset = r.dataset) GROUP BY r.dataset, r.algorithm) SELECT a.dataset, a.algorithm, round(b.v / a.v, 6) AS ratio FROM m a JOIN m b ON a.dataset = b.dataset AND b.algorithm = '5-LOW' WHERE a.algorithm <> '5-LOW'",
    "common_population": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "best_of": f"WITH m AS (SELECT dataset, algorithm, median(seconds) AS v FROM {RUNS} AS r GROUP BY dataset, algorithm) SELECT dataset, algorithm, round(v, 4) AS v, v = min(v) OVER (PARTITION BY dataset) AS best FROM m",
    "first_as_reference": f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY dataset, algorithm, profile ORDER BY repeat, run_id) AS n FROM {RUNS} AS r) SELECT b.dataset, b.algorithm, b.profile, count(*) AS n, round(avg(abs(b.seconds - a.seconds)), 4) AS gap FROM k a JOIN k b ON a.dataset = b.dataset AND a.algorithm = b.algorithm AND a.profile = b.profile WHERE a.n = 1 AND b.n > 1 GROUP BY b.dataset, b.algorithm, b.profile",
    "task_grid": f"WITH d AS (SELECT DISTINCT dataset FROM {RUNS} AS r1), a AS (SELECT DISTINCT algorithm FROM {RUNS} AS r2), s AS (SELECT DISTINCT repeat FROM {RUNS} AS r3) SELECT dataset, algorithm, repeat, row_number() OVER (ORDER BY repeat, dataset, algorithm) - 1 AS execution_index FROM d CROSS JOIN a CROSS JOIN s WHERE NOT (dataset = 'MACHINERY' AND algorithm = '5-LOW')",
    "missing_results": "SELECT c_custkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey WHERE o_custkey IS NULL",
    "stage_shares": "WITH s AS (SELECT l_orderkey, l_returnflag AS stage, sum(greatest(l_extendedprice - 20000e0, 0e0)) AS v FROM {lineitem} GROUP BY l_orderkey, l_returnflag), t AS (SELECT l_orderkey, sum(v) AS total FROM s GROUP BY l_orderkey) SELECT stage, round(median(v), 4) AS median_v, round(avg(v / total), 6) AS share FROM s JOIN t USING (l_orderkey) WHERE total > 0 GROUP BY stage",
    "stage_pivot": "SELECT l_linestatus, round(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 6) AS a, round(avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 6) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS r FROM {lineitem} GROUP BY l_linestatus",
    "memory_peaks": "WITH f AS (SELECT user_id, event_type, value, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS base FROM {events}) SELECT user_id, round(max(value), 6) AS peak, round(max(value) - min(base), 6) AS over_base, count(*) AS n FROM f GROUP BY user_id",
    "trace_landmarks": "SELECT user_id, min(CASE WHEN value > 50 THEN event_id END) AS first_high, max(value) AS peak, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS n_high FROM {events} GROUP BY user_id",
    "arc_length": "WITH g AS (SELECT user_id, event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM {events}) SELECT user_id, count(*) AS n, round(sum(coalesce(gap, 0e0)), 4) AS length FROM g GROUP BY user_id",
    "top_k_criteria": "WITH c AS (SELECT l_shipdate, l_orderkey, l_linenumber, 'price' AS criterion, l_extendedprice AS v FROM {lineitem} UNION ALL SELECT l_shipdate, l_orderkey, l_linenumber, 'quantity', l_quantity FROM {lineitem}), k AS (SELECT *, row_number() OVER (PARTITION BY criterion, year(l_shipdate) ORDER BY v DESC, l_orderkey, l_linenumber) AS place FROM c) SELECT criterion, year(l_shipdate) AS epoch, place, l_orderkey, round(v, 4) AS v FROM k WHERE place <= 10",
    "degree_percentile": "WITH d AS (SELECT o_custkey AS id, count(*) AS degree FROM {orders} GROUP BY o_custkey) SELECT id, degree, round(100e0 * (row_number() OVER (ORDER BY degree, id) - 1) / ((SELECT count(*) FROM d) - 1), 6) AS pct FROM d",
    "duplicate_rows": "WITH g AS (SELECT l_quantity, l_discount, count(*) AS n FROM {lineitem} GROUP BY l_quantity, l_discount) SELECT count(*) AS unique_rows, sum(n) - count(*) AS duplicates, max(n) AS largest FROM g",
    "apply_spec": "SELECT event_id, event_type, value FROM {events} WHERE lower(trim(event_type)) NOT IN ('', 'nan', 'none', 'unknown') AND event_type IN (SELECT event_type FROM {events} GROUP BY event_type HAVING count(*) > 10) AND value >= 10 AND value < 60",
    "label_frequency": "SELECT event_type AS label, count(*) AS n FROM {events} GROUP BY event_type",
    "label_encoding": "SELECT c_custkey AS id, c_mktsegment AS label, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM {customer}",
    "normalized_token": "SELECT p_partkey, translate(lower(p_name), ' #-_.', '') AS token FROM {part}",
    "alias_match": "WITH a AS (SELECT lower(n_name) AS token, n_nationkey AS k FROM {nation} UNION ALL SELECT lower(r_name), r_regionkey FROM {region}), f AS (SELECT s_suppkey, lower(n_name) AS token FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey), m AS (SELECT f.s_suppkey, count(a.k) AS n FROM f LEFT JOIN a ON a.token = f.token GROUP BY f.s_suppkey) SELECT s_suppkey, n, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM m",
    "profile_features": "SELECT 'l_discount' AS feature, count(l_discount) AS n, sum(CASE WHEN l_discount < 0 THEN 1 ELSE 0 END) AS negative, round(avg(CASE WHEN l_discount = 0 THEN 1e0 ELSE 0e0 END), 6) AS zero_rate, min(l_discount) AS low, round(median(l_discount), 6) AS middle, max(l_discount) AS high, min(l_discount) = max(l_discount) AS constant FROM {lineitem} UNION ALL SELECT 'l_quantity', count(l_quantity), sum(CASE WHEN l_quantity < 0 THEN 1 ELSE 0 END), round(avg(CASE WHEN l_quantity = 0 THEN 1e0 ELSE 0e0 END), 6), min(l_quantity), round(median(l_quantity), 6), max(l_quantity), min(l_quantity) = max(l_quantity) FROM {lineitem}",
    "numeric_frame": "SELECT lang, count(*) AS n, sum(CASE WHEN try_cast(replace(source, 'src', '') AS INT) IS NULL THEN 1 ELSE 0 END) AS failures, sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS nulls FROM {documents} GROUP BY lang",
    "reindex_left": "SELECT o_orderkey, o_custkey, c_mktsegment FROM {orders} LEFT JOIN (SELECT * FROM {customer} WHERE c_nationkey < 10) AS c ON o_custkey = c_custkey",
    "compare_to_reference": "WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM {orders} WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey), b AS (SELECT o_custkey AS k, count(*) AS v FROM {orders} WHERE o_orderkey % 3 <> 1 GROUP BY o_custkey) SELECT coalesce(a.k, b.k) AS k, a.v AS expected, b.v AS actual FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v",
    "validate_labels": "SELECT 'target without row' AS violation, count(*) AS n FROM {labels} l LEFT JOIN {documents} d ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL UNION ALL SELECT 'label outside 0, 1', count(*) FROM {labels} WHERE toxic NOT IN (0, 1) UNION ALL SELECT 'repeated id', count(*) FROM (SELECT doc_id FROM {labels} GROUP BY doc_id HAVING count(*) > 1) AS x",
    "change_categories": "WITH c AS (SELECT CASE WHEN quality = toxic THEN 'same' WHEN quality = 0 THEN 'noise to cluster' WHEN toxic = 0 THEN 'cluster to noise' ELSE 'cluster to cluster' END AS change FROM {labels}) SELECT change, count(*) AS n, round(100e0 * count(*) / (SELECT count(*) FROM c), 6) AS pct FROM c GROUP BY change",
    "contingency": "SELECT quality, toxic, count(*) AS n FROM {labels} GROUP BY quality, toxic",
    "robust_bbox": "WITH p AS (SELECT quantile_cont(l_quantity, 0.01) AS x1, quantile_cont(l_quantity, 0.99) AS x9, quantile_cont(l_extendedprice, 0.01) AS y1, quantile_cont(l_extendedprice, 0.99) AS y9, min(l_quantity) AS x0, max(l_quantity) AS x10, min(l_extendedprice) AS y0, max(l_extendedprice) AS y10 FROM {lineitem}) SELECT round((x9 - x1) * (y9 - y1), 4) AS robust_area, round((x10 - x0) * (y10 - y0), 4) AS area FROM p",
    "label_shapes": "WITH s AS (SELECT l_returnflag AS label, count(*) AS n, var_samp(l_quantity) AS a, var_samp(l_tax) AS d, covar_samp(l_quantity, l_tax) AS b FROM {lineitem} GROUP BY l_returnflag HAVING count(*) >= 30), e AS (SELECT label, n, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS e1, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) AS e2 FROM s) SELECT label, n, round(e1, 4) AS e1, round(1 - e2 / e1, 4) AS linearity FROM e",
}


def spark_text(plan: str) -> str:
    return plan.replace("quantile_cont(", "percentile(")
