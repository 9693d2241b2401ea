"""Routers, principal components and results against NumPy and by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from juryframe.operators import dense, pca, results, segments, stats
from juryframe.plans.catalogue import QUERIES


def exact(points, k=2):
    centred = points - points.mean(axis=0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:k]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return centred @ (axes * signs[:, None]).T, s[:k] ** 2 / (len(points) - 1)


def test_axes_are_numpys(spark, sf_dir):
    """Every row of the query, signs included."""
    rows = {r["vec_id"]: r["pca"] for r in QUERIES["pca_frames"](spark, sf_dir).collect()}
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    want, variances = exact(np.stack(table["embedding"]).astype(float))
    assert np.allclose([rows[i] for i in table["vec_id"]], want, atol=1e-8)
    assert np.allclose(pca.fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding").variances, variances)


def test_axes_pass_over_nulls(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + 7
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(200, None)], "i int, v array<double>").repartition(6)
    found = {r["i"]: r["pca"] for r in pca.principal_axes(df, "v", 3).collect()}
    assert found.pop(200) is None
    assert np.allclose([found[i] for i in range(200)], exact(points, 3)[0])
    with pytest.raises(ValueError):
        pca.fit(df.filter("v is null"), "v")


def test_error_function(spark):
    xs = [0.0, 1e-9, 0.3, -0.3, 1.0, 2.5, -4.0, 5.99, 6.5, -40.0]
    found = spark.createDataFrame([(x,) for x in xs], "x double").select("x", dense.erf(F.col("x")).alias("e")).collect()
    assert all(r["e"] == pytest.approx(math.erf(r["x"]), abs=1e-14) for r in found)


def test_dense_layers_are_numpys(spark):
    rng = np.random.default_rng(4)
    sizes = (6, 5, 4, 3)
    layers = [(rng.normal(size=(o, i)), rng.normal(size=o)) for i, o in zip(sizes[:-1], sizes[1:], strict=True)]
    points = rng.normal(size=(9, 6))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "i int, x array<double>")
    found = df.join(F.broadcast(dense.layers_table(spark, layers)), how="cross").select("i", dense.route(F.col("x"), F.col("layers"), 3).alias("p")).orderBy("i").collect()
    v = points
    for n, (kernel, bias) in enumerate(layers):
        v = v @ kernel.T + bias
        if n < 2:
            v = 0.5 * v * (1 + np.vectorize(math.erf)(v / math.sqrt(2)))
    p = np.exp(v - v.max(axis=1, keepdims=True))
    assert np.allclose([r["p"] for r in found], p / p.sum(axis=1, keepdims=True))
    with pytest.raises(ValueError):
        dense.route(F.col("x"), F.col("layers"), 0)


def test_pooled_experts_stand_side_by_side(spark):
    rows = [(k, t, [float(k + t), float(t)]) for k in (1, 2) for t in range(5)]
    parts = segments.segmented(spark.createDataFrame(rows, "k long, t long, f array<float>"), "k", "t", "f", 2)
    wide = parts.withColumn("frames", F.transform("frames", lambda f: F.concat(f, F.array(F.lit(9.0).cast("float")))))
    found = {r["k"]: r["pooled"] for r in dense.pool_experts({"a": parts, "b": wide}, "k").collect()}
    assert found == {1: [3, 2, 3, 2, 9], 2: [4, 2, 4, 2, 9]}


def test_waves_have_the_sizes_asked_for(spark):
    (row,) = spark.range(1).select(dense.waves((4, 3, 2)).alias("l")).collect()
    assert [(len(x["kernel"]), len(x["kernel"][0]), x["bias"]) for x in row["l"]] == [(3, 4, [0.0] * 3), (2, 3, [0.0] * 2)]
    assert row["l"][1]["kernel"][1][2] == pytest.approx(math.sin(13 + 14 + 1) * math.sqrt(6 / 5))


def test_pooled_router_is_numpys(spark, sf_dir):
    """Every row of mlp_pool_route, by its seeded weights."""
    from juryframe.operators import router

    found = {r["clip_id"]: r["probs"] for r in QUERIES["mlp_pool_route"](spark, sf_dir).collect()}
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    means = {k: np.stack(g["embedding"]).astype(float).mean(axis=0) for k, g in table.groupby("label")}
    want = router.probabilities(np.stack([means[k] for k in sorted(means)]), router.Weights.seeded(64, 32, 3))
    assert np.allclose([found[k] for k in sorted(means)], want)


ROUTED = "run string, split string, hubert_wer double, whisper_wer double, w2v2_wer double, probs array<double>"


@pytest.fixture(scope="module")
def routed(spark):
    rows = [("x", "test", 0.1, 0.2, 0.3, [0.6, 0.3, 0.1]), ("x", "test", 0.5, 0.2, 0.3, [0.6, 0.3, 0.1]), ("x", "val", 0.5, 0.2, 0.3, [0.2, 0.2, 0.6]), ("y", "test", 0.5, 0.2, 0.3, [0.1, 0.8, 0.1])]
    return spark.createDataFrame(rows, ROUTED)


def test_metrics_by_run_and_split(routed):
    """Every group is that of the rows it covers, taken alone."""
    found = {(r["run"], r["split"]): r for r in stats.router_metrics(routed, ["run", "split"]).collect()}
    assert set(found) == {("x", "test"), ("x", "val"), ("y", "test"), ("x", None), ("y", None), (None, "test"), (None, "val"), (None, None)}
    for (run, split), r in found.items():
        part = routed.filter(F.lit(run is None) | (F.col("run") == F.lit(run))).filter(F.lit(split is None) | (F.col("split") == F.lit(split)))
        (alone,) = stats.router_metrics(part).collect()
        assert {k: v for k, v in r.asDict().items() if k not in ("run", "split")} == alone.asDict()
    assert found["x", "test"]["selected_wer"] == 0.3 and found["x", "test"]["selection_accuracy"] == 0.5


def test_confusion_by_run_and_split(routed):
    found = {(r["run"], r["split"], r["oracle"]): (r["to_hubert"], r["to_whisper"], r["to_w2v2"]) for r in stats.confusion_matrix(routed, ["run", "split"]).collect()}
    assert len(found) == 8 * 3
    assert found["x", "test", "hubert"] == (1, 0, 0) and found["x", "test", "whisper"] == (1, 0, 0) and found["x", "test", "w2v2"] == (0, 0, 0)
    assert found["x", None, "whisper"] == (0.5, 0, 0.5)


@pytest.fixture
def work(spark):
    calls = []

    def run(unit):
        calls.append(unit)
        return spark.createDataFrame([("test", "wer", float(len(calls)))], results.LONG)

    run.calls = calls
    return run


def test_results_go_on_where_they_stopped(spark, tmp_path, work):
    path = str(tmp_path / "results")

    def fails(unit):
        if unit == "b/2":
            raise RuntimeError("lost")
        return work(unit)

    with pytest.raises(RuntimeError):
        results.fill(spark, path, ["a", "b/2", "c=3"], fails)
    assert results.finished(spark, path) == {"a"}
    assert results.fill(spark, path, ["a", "b/2", "c=3"], work) == ["b/2", "c=3"]
    assert results.finished(spark, path) == {"a", "b/2", "c=3"}
    read = lambda: {r["unit"]: r["value"] for r in results.read(spark, path).collect()}
    assert read() == {"a": 1, "b/2": 2, "c=3": 3}
    assert results.fill(spark, path, ["a", "b/2"], work) == []
    assert results.fill(spark, path, ["a", "b/2", "c=3"], work, again=["a"]) == ["a"]
    assert read() == {"a": 4, "b/2": 2, "c=3": 3} and work.calls == ["a", "b/2", "c=3", "a"]


def test_interrupted_unit_is_as_it_was(spark, tmp_path, work):
    path = str(tmp_path / "results")
    results.fill(spark, path, ["a"], work)

    def breaks(unit):
        return work(unit).withColumn("value", F.raise_error(F.lit("lost")).cast("double"))

    with pytest.raises(Exception, match="lost"):
        results.fill(spark, path, ["a", "b"], breaks, again=["a"])
    assert results.finished(spark, path) == {"a"}
    assert [(r["unit"], r["value"]) for r in results.read(spark, path).collect()] == [("a", 1.0)]


def test_units_without_rows_are_not_finished(spark, tmp_path):
    path = str(tmp_path / "results")
    assert results.finished(spark, path) == set()
    results.fill(spark, path, ["none"], lambda u: spark.createDataFrame([], results.LONG))
    assert results.finished(spark, path) == set()


def test_long_rows(spark):
    df = spark.createDataFrame([("test", 0.5, None), ("val", None, 2.0)], "split string, wer double, n double")
    assert sorted(tuple(r) for r in results.long(df, ["split"], ["wer", "n"]).collect()) == [("test", "wer", 0.5), ("val", "n", 2.0)]


def test_priors_fall_back(spark):
    none = spark.createDataFrame([], "hubert_wer double, whisper_wer double, w2v2_wer double")
    assert {r["expert"]: r["prior"] for r in stats.priors_or_fallback(stats.class_priors(none)).collect()} == {"hubert": 0.323, "whisper": 0.444, "w2v2": 0.233}
    some = spark.createDataFrame([(0.1, 0.2, 0.3), (0.4, 0.2, 0.3)], none.schema)
    assert {r["expert"]: r["prior"] for r in stats.priors_or_fallback(stats.class_priors(some)).collect()} == {"hubert": 0.5, "whisper": 0.5, "w2v2": 0.0}


def test_units_are_filled_in_one_pass(spark, tmp_path):
    path, calls = str(tmp_path / "together"), []

    def work(units):
        calls.append(units)
        return spark.createDataFrame([(u, "test", "wer", float(len(calls))) for u in units], "unit string, split string, metric string, value double")

    assert results.fill_together(spark, path, ["a", "b/2"], work) == ["a", "b/2"]
    assert results.fill_together(spark, path, ["a", "b/2", "c=3", "d"], work) == ["c=3", "d"] and calls == [["a", "b/2"], ["c=3", "d"]]
    assert results.fill_together(spark, path, ["a", "d"], work) == [] and len(calls) == 2
    assert {r["unit"]: r["value"] for r in results.read(spark, path).collect()} == {"a": 1.0, "b/2": 1.0, "c=3": 2.0, "d": 2.0}


def test_resumed_results_reads_its_table_once_a_go(spark, sf_dir, monkeypatch):
    goes, own = [], results.fill_together
    monkeypatch.setattr(results, "fill_together", lambda s, path, units, work: (goes.append(done := own(s, f"{path}-once", units, work)), done)[1])
    monkeypatch.setattr(results, "read", lambda s, path: s.range(1))
    QUERIES["resumed_results"](spark, sf_dir)
    assert [len(g) for g in goes] == [2, 3]
