"""Paired differences of repeated measurements, with a check that every repeat is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATISTICS = {"median": F.median, "mean": F.avg}


def paired_deltas(rows: DataFrame, comparisons: list[tuple[str, str, str]], repeats: list[int], statistic: str = "median") -> DataFrame:
    """(comparison, dataset, metric, candidate_value, baseline_value, paired_delta) of comparisons (key, candidate, baseline).

    rows(dataset, algorithm, metric, repeat, value): one group is a dataset, an algorithm and a metric, and its
    value the statistic over its rows. A pair whose groups don't hold exactly the repeats stops the query, and so
    does a null or NaN value of a pair; groups without a partner are passed over. No rows give no pairs.
    """
    if statistic not in STATISTICS:
        raise ValueError(f"statistic is one of {sorted(STATISTICS)}")
    keys = ["dataset", "metric"]
    v = F.col("value").cast("double")
    grouped = rows.filter(F.col("algorithm").isin([a for _, *pair in comparisons for a in pair])).groupBy(*keys, "algorithm")
    values = grouped.agg(
        STATISTICS[statistic](v).alias("of"),
        F.array_sort(F.collect_set(F.col("repeat").cast("int"))).alias("found"),  # as many as there are repeats
        F.count(F.when(v.isNull() | F.isnan(v), 1)).alias("absent"),
    )
    names = rows.sparkSession.createDataFrame(comparisons, "comparison string, candidate string, baseline string")
    side = lambda name: values.select(*keys, F.col("algorithm").alias(name), F.struct("of", "found", "absent").alias(f"{name}_group"))
    pairs = F.broadcast(names).join(side("candidate"), "candidate").join(side("baseline"), [*keys, "baseline"])  # one row a comparison
    wanted = F.array(*(F.lit(r).cast("int") for r in sorted(set(repeats))))

    def checked(name: str):
        group = F.col(f"{name}_group")
        whole = (group["found"] == wanted) & (group["absent"] == 0)
        said = F.concat(F.lit("incomplete repeats of "), F.col(name), F.lit(" on "), F.col("dataset"), F.lit(", "), F.col("metric"))
        return F.when(whole, group["of"]).otherwise(F.raise_error(said).cast("double"))

    out = pairs.select("comparison", *keys, checked("candidate").alias("candidate_value"), checked("baseline").alias("baseline_value"))
    return out.withColumn("paired_delta", F.col("candidate_value") - F.col("baseline_value"))
