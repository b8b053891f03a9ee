"""Column functions of dataset preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldweave.operators.saving import saved

# Words read as true, and words read as missing.
TRUE_WORDS = ("true", "1", "t", "yes", "y")
MISSING_WORDS = ("", "nan", "none", "na", "not provided", "unknown", "null")


def as_bool(c: Column, kind: str = "string") -> Column:
    """Lenient truth by the column's type: booleans; numbers whose whole part is not 0; of text, the usual words. Null is false."""
    if kind == "boolean":
        told = c
    elif kind == "string":
        told = F.lower(F.trim(c)).isin(*TRUE_WORDS)
    else:
        number = c.cast("double")
        told = F.when(~F.isnan(number), F.abs(number) >= 1)
    return F.coalesce(told, F.lit(False))


def is_informative(c: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*MISSING_WORDS)


def threshold_label(value: float) -> str:
    """A number as part of a column name."""
    return f"{value:g}".replace("-", "m").replace(".", "p")


def norm_statistics(rows: DataFrame, column: str, prefix: str = "norm", thresholds: tuple[float, ...] = ()) -> DataFrame:
    """Greatest, mean and high percentiles of a column, and how many values lie above each threshold."""
    q = F.percentile(column, [0.95, 0.99, 0.999])
    out = rows.agg(F.max(column).alias("a"), F.avg(column).alias("b"), q.alias("q"), F.count(column).alias("n"), *(F.count_if(F.col(column) > t).alias(f"c{i}") for i, t in enumerate(thresholds)))
    names = [(f"{prefix}_{k}", F.get("q", F.lit(i))) for i, k in enumerate(("p95", "p99", "p999"))]
    counts = [x for i, t in enumerate(thresholds) for x in ((f"{prefix}_gt_{threshold_label(t)}_count", F.col(f"c{i}")), (f"{prefix}_gt_{threshold_label(t)}_pct", 100.0 * F.col(f"c{i}") / F.greatest("n", F.lit(1))))]
    return out.select(F.col("a").alias(f"{prefix}_max"), F.col("b").alias(f"{prefix}_mean"), *(c.alias(n) for n, c in names + counts))


def numbered(rows: DataFrame, by: str, order: list[str], out: str) -> DataFrame:
    """rows with their place (from 1) among those of the same ``by``, in an order without ties.

    Rows are sorted in ranges of (by, order) and numbered within each; a range's rows of a group are offset by the
    group's rows in the ranges before. No task holds a whole group.
    """
    dealt = saved(rows.repartitionByRange(by, *order).withColumn("__p", F.spark_partition_id()))
    counts = dealt.groupBy(by, "__p").agg(F.count(F.lit(1)).alias("__n"))  # a row a group, and one for each border
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(by, "__p", F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__p", by).orderBy(*order))
    return dealt.withColumn("__place", place).join(starts, [by, "__p"]).withColumn(out, F.col("__start") + F.col("__place")).drop("__p", "__place", "__start")


def permuted_features(rows: DataFrame, seed: int = 1000) -> DataFrame:
    """points(id, features) with the values of each feature dealt anew over the points.

    Feature by feature, the n-th value by one hash goes to the n-th point by another; marginals stay, joint
    structure goes, and the outcome is the same on any partitioning. Places are counted per feature, over ranges
    of hashes, so that a feature's values are spread over tasks.
    """
    each = rows.select("id", F.posexplode("features").alias("f", "v"))
    hashed = lambda k: each.withColumn("h", F.xxhash64("id", "f", F.lit(seed), F.lit(k)))
    given = numbered(hashed(0), "f", ["h", "id"], "n").select("f", "v", "n")
    taken = numbered(hashed(1), "f", ["h", "id"], "n").select("id", "f", "n")
    both = taken.join(given, ["f", "n"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("p"))
    return both.select("id", F.col("p.v").alias("features"))


def normalized_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def last_part(c: Column, sep: str = "_") -> Column:
    return F.element_at(F.split(c, sep), -1)


def encoded(rows: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Codes 0.. by sorted distinct label; the label table is joined, never one global window over rows."""
    names = rows.select(label).filter(F.col(label).isNotNull()).distinct()
    coded = names.withColumn(code, F.row_number().over(Window.orderBy(label)) - 1)
    return rows.join(coded, label, "left")


def normalize_log1p(cells: DataFrame) -> DataFrame:
    """Sparse counts (row, feature, value): rows scaled to the median positive row sum, then log1p."""
    sums = cells.groupBy("row").agg(F.sum("value").alias("total")).filter("total > 0")
    target = sums.agg(F.median("total").alias("target"))
    return cells.join(sums, "row").crossJoin(F.broadcast(target)).select("row", "feature", F.log1p(F.col("value") * F.col("target") / F.col("total")).alias("value"))


def quantized(layout: DataFrame, levels: int = 65535) -> DataFrame:
    """Positions on an integer grid with one scale for both axes; halves round to even."""
    b = layout.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    scale = F.when(F.col("span") > 0, levels / F.col("span")).otherwise(0.0)
    return layout.crossJoin(F.broadcast(b)).select("id", F.bround((F.col("x") - F.col("x0")) * scale).cast("int").alias("qx"), F.bround((F.col("y") - F.col("y0")) * scale).cast("int").alias("qy"))


def feature_profile(rows: DataFrame, *columns: str) -> DataFrame:
    """Per column: finite, NaN, infinite, negative and null counts, zero rate, extremes, median, constant."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("e")).select("e.*")
    v, inf = F.col("v"), F.abs("v") == float("inf")
    finite = F.when(~F.isnan(v) & ~inf, v)
    return long.groupBy("feature").agg(
        F.count(finite).alias("n_finite"), F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(inf).alias("n_inf"), F.count_if(finite < 0).alias("n_negative"), F.count_if(v.isNull()).alias("n_null"),
        F.avg((finite == 0).cast("double")).alias("zero_rate"), F.min(finite).alias("low"), F.median(finite).alias("middle"), F.max(finite).alias("high"), (F.min(finite) == F.max(finite)).alias("constant"),
    )
