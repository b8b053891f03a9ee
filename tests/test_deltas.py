import pytest

from fieldweave.operators import deltas

COLUMNS = "dataset string, algorithm string, metric string, repeat int, value double"
PAIRS = [("ours", "new", "old")]


def _rows(spark, values):
    return spark.createDataFrame([(d, a, "m", k, v) for (d, a), vs in values.items() for k, v in enumerate(vs, 1)], COLUMNS)


def test_medians_and_means_by_hand(spark):
    rows = _rows(spark, {("d", "new"): [1.0, 9.0, 2.0], ("d", "old"): [4.0, 3.0, 8.0], ("e", "new"): [1.0, 1.0, 1.0], ("d", "third"): [0.0]})
    r = deltas.paired_deltas(rows, PAIRS, [1, 2, 3]).collect()
    assert [tuple(x) for x in r] == [("ours", "d", "m", 2.0, 4.0, -2.0)]  # e has no baseline, the third no comparison
    r = deltas.paired_deltas(rows, PAIRS, [1, 2, 3], "mean").first()
    assert (r.candidate_value, r.baseline_value, r.paired_delta) == (4.0, 5.0, -1.0)
    assert deltas.paired_deltas(rows.limit(0), PAIRS, [1]).count() == 0


@pytest.mark.parametrize("new", [[1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [1.0, None, 3.0], [1.0, float("nan"), 3.0]])
def test_incomplete_repeats_stop_the_query(spark, new):
    rows = _rows(spark, {("d", "new"): new, ("d", "old"): [4.0, 3.0, 8.0]})
    with pytest.raises(Exception, match="incomplete repeats of new on d, m"):
        deltas.paired_deltas(rows, PAIRS, [1, 2, 3]).collect()


def test_unknown_statistic(spark):
    with pytest.raises(ValueError):
        deltas.paired_deltas(_rows(spark, {("d", "new"): [1.0]}), PAIRS, [1], "mode")
