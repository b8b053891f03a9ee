import zipfile

import numpy as np
import pytest

from fieldweave.functions import columns as C
from fieldweave.operators import quality, stability
from fieldweave.sources import files
from fieldweave.streaming import monitor


def test_arrays_and_archives(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "x.npy", x)
    assert [r.features for r in files.read_npy(spark, str(tmp_path / "x.npy")).orderBy("id").collect()] == x.tolist()
    (tmp_path / "x.idx").write_bytes(b"\0\0\x08\x02" + np.array([4, 3], ">i4").tobytes() + x.astype(np.uint8).tobytes())
    assert files.read_idx(spark, str(tmp_path / "x.idx")).count() == 4
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t.csv", "a,b\n1,2\n")
    assert [r.line for r in files.read_zip_lines(spark, str(tmp_path / "a.zip"), "t.csv").orderBy("line_no").collect()] == ["a,b", "1,2"]


def test_columns(spark):
    rows = spark.createDataFrame([(1, " Yes", "B"), (2, "0", "A"), (3, None, "B"), (4, "2.5", None)], "id long, flag string, label string")
    assert [r.b for r in rows.orderBy("id").select(C.as_bool(rows.flag).alias("b")).collect()] == [True, False, False, False]
    numbers = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, -2.5), (4, None), (5, float("nan"))], "id long, v double")
    assert [r.b for r in numbers.orderBy("id").select(C.as_bool(numbers.v, "double").alias("b")).collect()] == [False, True, True, False, False]
    assert {r.id: r.code for r in C.encoded(rows, "label").collect()} == {1: 1, 2: 0, 3: 1, 4: None}
    assert rows.filter(C.is_informative(rows.label)).count() == 3
    profile = C.feature_profile(spark.createDataFrame([(1.0,), (0.0,), (float("nan"),), (None,)], "v double"), "v").first()
    assert (profile.n_finite, profile.n_nan, profile.n_null, profile.zero_rate) == (2, 1, 1, 0.5)


def test_stability(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(40, 2))
    for q in (p @ np.array([[0.6, 0.8], [-0.8, 0.6]]) * 3 + 5, p * np.array([1, -1]) * 2):
        frames = [spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)], "id long, x double, y double") for z in (p, q)]
        assert stability.procrustes(*frames).first().rms < 1e-7
    line = spark.createDataFrame([(i, i * 1.0, i * 0.5) for i in range(20)], "id long, x double, y double")
    times = spark.createDataFrame([(i, 20.0 - i) for i in range(20)], "id long, t double")
    assert abs(stability.pseudotime_correlation(line, times).first().rho - 1) < 1e-12
    vectors = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(p)], "id long, features array<double>")
    scores = stability.cell_similarity(vectors, vectors)
    assert all(abs(r.rho - 1) < 1e-9 for r in scores.collect())
    told = spark.createDataFrame([(i, float(i)) for i in range(5)], "src long, rho double")
    base = spark.createDataFrame([(i, v) for i, v in enumerate((1.0, 1.5, 2.5, 3.0))], "src long, rho double")
    assert {r.src: r.label for r in stability.reliability(told, base, 0.0, 1.0).collect()} == {0: "dubious", 1: "intermediate", 2: "intermediate", 3: "intermediate", 4: "trustworthy"}


def test_monitor_on_a_stream(spark, sf, tmp_path):
    log = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "log"))
    query = monitor.stage_peaks(stream).writeStream.outputMode("complete").format("memory").queryName("peaks").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("peaks").count() == monitor.stage_peaks(log).count()


def test_labels_and_contract(spark, tmp_path):
    obs = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "sample_id long, cell_type string, size int")
    assert files.choose_label_column({"label_columns": ["absent", "size"]}, obs.columns) == "size"
    assert files.choose_label_column({"default_color_by": "cell_type", "label_columns": ["size"]}, obs.columns, ["nothing"]) == "cell_type"
    assert files.choose_label_column({}, obs.columns) == "cell_type" and files.choose_label_column({}, ["x"]) is None
    labels, source = files.load_labels({}, obs)
    assert source == "cell_type" and {r.sample_id: r.value for r in labels.collect()} == {1: "a", 2: "b"}
    assert files.load_labels({}, obs.select("sample_id")) is None
    assert [r.value for r in files.obs_column(obs, "size", chosen=spark.createDataFrame([(2,)], "sample_id long")).collect()] == [3]
    with pytest.raises(KeyError):
        files.obs_column(obs, "absent")
    (tmp_path / "metadata.json").write_text('{"feature_shape": [2, 3], "identifier_column": "sample_id", "obs_schema": {"cell_type": {}, "age": {}}}')
    metadata = files.read_metadata(spark, str(tmp_path))
    features = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0])], "id long, features array<float>")
    assert files.check_contract(metadata, features, obs) == ["obs lacks age"]
    assert len(files.check_contract(metadata, features.limit(1), obs.union(obs))) == 4
    files.write_npz(features, str(tmp_path / "z"))
    assert sorted(map(tuple, ((r.id, *r.features) for r in files.read_npz(spark, str(tmp_path / "z")).collect()))) == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
    for rows in (obs, obs.limit(1)):
        files.write_atomically(rows, str(tmp_path / "t"), "json")
        assert spark.read.json(str(tmp_path / "t")).count() == rows.count()
    files.write_jsonl(obs, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "sample_id long, size int").count() == 2


def test_permuted_features_keep_their_marginals(spark):
    x = np.arange(48.0).reshape(12, 4)
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    got = np.array([r.features for r in C.permuted_features(points, 7).orderBy("id").collect()])
    again = np.array([r.features for r in C.permuted_features(points.repartition(5), 7).orderBy("id").collect()])
    assert (np.sort(got, 0) == x).all() and (got == again).all() and (got != x).any()


def test_chance_of_a_correlation():
    assert quality.p_value(0.0, 20) == pytest.approx(1.0) and quality.p_value(1.0, 9) == 0.0
    # with 4 points t has 2 degrees of freedom and the chance is 1 - |rho|
    assert all(quality.p_value(r, 4) == pytest.approx(1 - abs(r)) for r in (0.3, -0.8, 0.95))
