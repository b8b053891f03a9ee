"""Agreement of two labelings beyond the Rand index, and matching of label names.

Mutual information is summed in Spark. For the matching the contingency table, whose size is that of the label
sets, reaches the driver, up to a stated number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.saving import saved

NOISE = -1
#: Deviations beyond which an overlap by chance is left out.
SPREADS = 40
#: Label pairs that may be gathered for matching.
MOST_CELLS = 1_000_000


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest one-to-one assignment (rows <= columns), by shortest augmenting paths."""
    rows, cols = cost.shape
    if rows > cols:
        raise ValueError("more rows than columns")
    u, v = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for row in range(rows):
        slack, via, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        i, last, path = row, -1, []
        while True:
            gap = cost[i] - u[i] - v
            better = ~done & (gap < slack)
            slack[better], via[better] = gap[better], last
            j = int(np.argmin(np.where(done, np.inf, slack)))
            step = slack[j]
            u[row] += step
            for k in path:
                u[owner[k]] += step
                v[k] -= step
            slack[~done] -= step
            done[j] = True
            if owner[j] < 0:
                break
            path.append(j)
            i, last = owner[j], j
        while j >= 0:
            prev = via[j]
            owner[j] = owner[prev] if prev >= 0 else row
            j = prev
    out = np.empty(rows, int)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def contingency(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _cells(pairs: DataFrame) -> list[tuple]:
    rows = contingency(pairs).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError("too many label pairs")
    return [tuple(r) for r in rows]


def _chance(total: int):
    """Expected mutual information of pairs of label sizes (x, many_x, y, many_y), summed by batch.

    The overlap of two labels is hypergeometric. Its weights come from ratios beside the mode, over their own sum,
    and overlaps that lie more than SPREADS deviations off add less than rounding does.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = 0.0
            for x, many_x, y, many_y in batch.itertuples(index=False):
                low, high = max(0, x + y - total), min(x, y)
                mode = min(max((x + 1) * (y + 1) // (total + 2), low), high)
                wide = int(SPREADS * sqrt(x * y / total * (total - x) / total * (total - y) / max(total - 1, 1))) + 64
                low, high = max(low, mode - wide), min(high, mode + wide)
                n = np.arange(low, high + 1, dtype=float)
                step = np.log((x - n[:-1]) * (y - n[:-1])) - np.log((n[:-1] + 1) * (total - x - y + n[:-1] + 1))
                logs = np.append(0.0, np.cumsum(step))
                weight = np.exp(logs - logs[mode - low])
                gain = np.zeros(len(n))
                some = n > 0
                gain[some] = n[some] / total * (np.log(n[some]) + log(total) - log(x) - log(y))
                found += many_x * many_y * float((weight * gain).sum() / weight.sum())
            yield pd.DataFrame({"expected": [found]})

    return kernel


def adjusted_mutual_information(pairs: DataFrame) -> float:
    """pairs(a, b): mutual information less its expectation under fixed margins, over the mean entropy less the same.

    Sums over cells and labels stay in Spark. The expectation needs each pair of distinct label sizes once; a side
    of n rows has at most sqrt(2 n) distinct sizes, so that there are at most 2 n such pairs. Null is a label.
    """
    cells = saved(contingency(pairs))
    total = cells.agg(F.sum("n")).first()[0]
    if not total:
        return 1.0
    sides = {c: saved(cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}"))) for c in "ab"}
    if all(side.count() == 1 for side in sides.values()):
        return 1.0
    share = lambda c: F.col(c) / F.lit(float(total))
    entropy = {c: side.agg(-F.sum(share(f"n_{c}") * F.log(share(f"n_{c}")))).first()[0] for c, side in sides.items()}
    joined = cells
    for c, side in sides.items():
        joined = joined.join(side.withColumnRenamed(c, f"{c}2"), F.col(c).eqNullSafe(F.col(f"{c}2")))
    mutual = joined.agg(F.sum(share("n") * F.log(share("n") / (share("n_a") * share("n_b"))))).first()[0]
    sizes = {c: side.groupBy(f"n_{c}").agg(F.count(F.lit(1)).alias(f"many_{c}")) for c, side in sides.items()}
    met = sizes["a"].repartition("n_a").crossJoin(sizes["b"]).select("n_a", "many_a", "n_b", "many_b")  # at most 2 n rows
    expected = met.mapInPandas(_chance(total), "expected double").agg(F.sum("expected")).first()[0]
    mean = (entropy["a"] + entropy["b"]) / 2
    return (mutual - expected) / (mean - expected) if abs(mean - expected) > 1e-15 else 1.0


def match_labels(pairs: DataFrame) -> dict:
    """New names for the labels b: the one-to-one matching to labels a with the greatest overlap.

    Noise keeps its name; labels without a partner get fresh numbers after the greatest label a.
    """
    cells = [(a, b, n) for a, b, n in _cells(pairs) if b != NOISE]
    left = sorted({a for a, _, _ in _cells(pairs) if a != NOISE})
    right = sorted({b for _, b, _ in cells})
    overlap = np.zeros((len(right), max(len(left), len(right))))
    for a, b, n in cells:
        if a != NOISE:
            overlap[right.index(b), left.index(a)] = n
    found = assignment(-overlap) if right else []
    out, fresh = {NOISE: NOISE}, max([NOISE, *left]) + 1
    for i, b in enumerate(right):
        if found[i] < len(left) and overlap[i, found[i]] > 0:
            out[b] = left[found[i]]
        else:
            out[b], fresh = fresh, fresh + 1
    return out


def label_changes(pairs: DataFrame) -> DataFrame:
    """Shares of rows whose label differs after matching, and of those that enter or leave noise."""
    names = match_labels(pairs)
    table = pairs.sparkSession.createDataFrame(list(names.items()), "b long, m long")
    noise = lambda c: F.col(c) == NOISE
    each = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).join(F.broadcast(table), "b")  # one row a label
    share = lambda c: F.avg(c.cast("double"))
    return each.agg(share(F.col("a") != F.col("m")).alias("changed"), share(noise("a") != noise("m")).alias("noise_flips"), share((F.col("a") != F.col("m")) & ~noise("a") & ~noise("m")).alias("between_clusters"), F.count(F.lit(1)).alias("n"))
