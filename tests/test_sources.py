import pytest
from pyspark.sql import functions as F

from juryframe.sources import clip_files


@pytest.fixture
def clips(spark, tmp_path):
    path = str(tmp_path / "clips.parquet")
    spark.range(3000).coalesce(1).withColumn("x", F.col("id") * 2).write.parquet(path)
    return path


def test_metadata(spark, clips):
    clip_files.write_metadata(spark, clips, {"regimes": [1, 2], "seed": 42})
    assert clip_files.read_metadata(spark, clips) == {"regimes": [1, 2], "seed": 42}
    assert any("spark" in k for k in clip_files.file_metadata(spark, clips))


def test_scan_prunes(spark, clips):
    assert clip_files.scan(spark, clips, ["x"]).columns == ["x"]
    assert clip_files.scan_sql(spark, clips, "x", "id = 7").collect()[0]["x"] == 14


def test_results(spark, tmp_path):
    path = str(tmp_path / "results")
    clip_files.write_results(spark.range(1).select(F.struct(F.lit(0.5).alias("wer")).alias("test")), path, "a")
    clip_files.write_results(spark.range(1).select(F.struct(F.lit(0.25).alias("wer")).alias("test")), path, "a")
    assert [r["method"] for r in clip_files.read_results(spark, path).select("method", "test.wer").collect()] == ["a"]


def test_audio_filters(spark):
    df = spark.createDataFrame([(1, ([0.0] * 3,)), (2, ([0.0] * 4,)), (3, ([],)), (4, (None,))], "id int, audio struct<array: array<float>>")
    assert [r["id"] for r in clip_files.long_audio(df, least=3).collect()] == [2]
    assert sorted(r["id"] for r in clip_files.some_audio(df).collect()) == [1, 2]


def test_scoreboard(spark, tmp_path):
    from juryframe.streaming.scoreboard import scoreboard

    rows = [("2026-01-01 00:01:00", 0.1, 0.2, 0.3), ("2026-01-01 00:02:00", 0.5, 0.2, 0.3), ("2026-01-01 00:31:00", 0.1, 0.2, 0.3)]
    batch = spark.createDataFrame(rows, "ts string, hubert_wer double, whisper_wer double, w2v2_wer double").withColumn("ts", F.to_timestamp("ts"))
    path = str(tmp_path / "stream")
    batch.write.parquet(path)
    stream = scoreboard(spark.readStream.schema(batch.schema).parquet(path))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("board").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("board").collect()) == sorted(scoreboard(batch).collect())
    assert [(r["n"], r["hubert_share"]) for r in spark.table("board").orderBy("start").collect()] == [(2, 0.5), (1, 1.0)]


def test_corpora(spark, tmp_path):
    from juryframe.sources import registry

    spark.createDataFrame([("hello",)], "normalized_text string").write.parquet(str(tmp_path / "en_accented/test"))
    assert registry.read_corpus(spark, str(tmp_path), "voxpopuli").first()["text"] == "hello"
    with pytest.raises(ValueError):
        registry.read_corpus(spark, str(tmp_path), "other")


def test_processed_path():
    from juryframe.sources.registry import processed_path

    known = {"a": ("s", "t")}
    assert processed_path("a", known) == ("s", "t") and processed_path("a", known, target="u") == ("s", "u")
    assert processed_path("b", known, "x", "y") == ("x", "y")
    with pytest.raises(ValueError):
        processed_path("b", known, "x")


def test_legacy_files(spark, tmp_path):
    import numpy as np

    from juryframe.sources import registry

    np.save(tmp_path / "0_hubert.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert registry.read_embeddings(spark, str(tmp_path / "*.npy")).first()["frames"] == [[1, 2], [3, 4]]
    (tmp_path / "metadata.json").write_text('[{"sample_id": 0, "hubert_wer": 0.5}, {"sample_id": 1, "hubert_wer": 0.25}]')
    assert registry.read_legacy_index(spark, str(tmp_path / "metadata.json")).agg(F.sum("hubert_wer")).first()[0] == 0.75


def test_steps(spark, tmp_path):
    from juryframe.sources import registry

    spark.createDataFrame([("loss", 1, 0.5), ("acc", 1, 0.1)], "tag string, step long, value double").write.parquet(str(tmp_path / "a"))
    found = registry.read_steps(spark, {"a": str(tmp_path / "a")}, ["loss", "gone"]).collect()
    assert [tuple(r) for r in found] == [("a", "loss", 1, 0.5)]


def test_scores_are_dealt_by_the_size_of_the_table(spark, sf_dir, monkeypatch):
    """Each part of a table that is read brings shuffle partitions of its own; small tables keep the shuffle's number."""
    from juryframe.sources import adapters

    plain = adapters.scores(spark, sf_dir)
    monkeypatch.setattr(adapters, "PARTS_OF_READ", 0)
    small = adapters.scores(spark, sf_dir)
    monkeypatch.setattr(adapters, "PARTS_OF_READ", 37)
    large = adapters.scores(spark, sf_dir)
    reads = spark.read.parquet(f"{sf_dir}/lineitem.parquet").rdd.getNumPartitions()
    assert large.rdd.getNumPartitions() == 37 * reads
    assert sorted(small.collect()) == sorted(large.collect()) == sorted(plain.collect())
