"""Exact quantiles of a whole column by narrowing brackets, without gathering it in one task."""

from __future__ import annotations

from math import floor as whole

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, or counted values, of a bracket that may be gathered.
FEW = 1000


def kth(rows: DataFrame, column: str, k: int) -> float:
    """The value of rank k (from 0), by brackets that each pass narrows; no sort and no gathering of the column.

    A value that fills its bracket is found at once, so ties do no harm.
    """
    low = high = None
    below, width = 0, 1e-3
    c = F.col(column)
    while True:
        held = rows if low is None else rows.filter(c.between(low, high))
        n = held.count()
        if low is not None and low == high:
            return low
        values = held.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column).limit(FEW + 1).collect() if n <= FEW or width >= 0.5 else []
        if 0 < len(values) <= FEW:
            for v, many in values:
                below += many
                if below > k:
                    return v
        share = (k - below) / n
        at = F.percentile_approx(c, F.array(F.lit(max(0.0, share - width)), F.lit(min(1.0, share + width))), F.lit(10_000)).alias("q")
        lo, hi = held.agg(at).first().q
        count = lambda p: F.count(F.when(p, 1))
        less, up_to = held.agg(count(c < lo).alias("a"), count(c <= hi).alias("b")).first()
        if below + less <= k < below + up_to and up_to - less < n:
            low, high, below, width = lo, hi, below + less, 1e-3
        elif width >= 0.5:  # brackets part nothing
            return held.select(column).orderBy(column).offset(k - below).first()[0]
        else:
            width *= 8


def quantile(rows: DataFrame, column: str, q: float) -> float | None:
    """Quantile with linear interpolation between ranks; nulls and NaN are passed over, None where nothing is left."""
    kept = rows.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n = kept.count()
    if not n:
        return None
    at = q * (n - 1)
    k = whole(at)
    low = kth(kept, "v", k)
    return low if at == k else low + (at - k) * (kth(kept, "v", k + 1) - low)
