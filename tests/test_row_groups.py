"""Footers, copies in small row groups and access by key and place, on files of several shapes."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from juryframe.sources import places, row_groups


@pytest.fixture
def clips(spark, tmp_path):
    path = str(tmp_path / "clips.parquet")
    spark.range(3000).coalesce(1).withColumn("x", F.col("id") * 2).write.parquet(path)
    return path


@pytest.fixture
def nested(tmp_path):
    """Files in folders of folders, one without rows, with groups of several sizes."""
    sizes = {"a/1.parquet": (10, 4), "a/b/2.parquet": (7, 7), "c/3.parquet": (0, 5), "4.parquet": (25, 10)}
    for i, (name, (rows, group)) in enumerate(sizes.items()):
        path = tmp_path / "nested" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"id": pa.array(range(100 * i, 100 * i + rows), pa.int64())}), path, row_group_size=group)
    return str(tmp_path / "nested")


def expected(root):
    out = []
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".parquet"):
                found, first = pq.ParquetFile(f"{folder}/{name}").metadata, 0
                for g in range(found.num_row_groups):
                    n = found.row_group(g).num_rows
                    out.append((os.path.relpath(f"{folder}/{name}", root), g, first, n, found.row_group(g).total_byte_size))
                    first += n
    return sorted(out)


@pytest.mark.parametrize("direct", [("file",), ()])
def test_footers_of_nested_folders(spark, nested, monkeypatch, direct):
    """By the files' tails, and through Spark's own reader where Arrow cannot open the store."""
    monkeypatch.setattr(row_groups, "DIRECT", direct)
    found = row_groups.footers(spark, nested).collect()
    assert sorted((r["file"].split("/nested/")[1], r["group"], r["first_row"], r["rows"], r["bytes"]) for r in found) == expected(nested)
    assert all(r["length"] == os.path.getsize(r["file"].removeprefix("file:")) for r in found)


def test_footers_of_no_rows(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert row_groups.footers(spark, str(tmp_path / "none")).agg(F.sum("rows")).first()[0] in (None, 0)


def test_rows_by_number(spark, nested):
    groups = row_groups.group_starts(spark, nested).cache()
    paths = sorted(row[0] for row in groups.select("file").distinct().collect())
    rows = [(p, i) for p in paths for i in range(pq.ParquetFile(p.removeprefix("file:")).metadata.num_rows)]
    first = {(r["file"], r["group"]): r["first_row"] for r in groups.collect()}
    for index in (0, 3, 4, 9, 24, 25, 34, 41):
        (found,) = row_groups.locate(groups, index).collect()
        assert (found["file"], first[found["file"], found["group"]] + found["place"]) == rows[index]
    assert row_groups.locate(groups, len(rows)).isEmpty() and row_groups.locate(groups, -1).isEmpty()


def test_rechunk(spark, clips, tmp_path):
    target = str(tmp_path / "small.parquet")
    row_groups.rechunk(spark, clips, target, 256)
    groups = [r["rows"] for r in row_groups.footers(spark, target).collect()]
    assert max(groups) <= 256 and sum(groups) == 3000
    assert spark.read.parquet(target).agg(F.sum("x")).first()[0] == 3000 * 2999


def test_rechunk_keeps_nested_rows_and_partition_columns(spark, nested, tmp_path):
    row_groups.rechunk(spark, nested, str(tmp_path / "flat"), 3)
    assert spark.read.parquet(str(tmp_path / "flat")).count() == 42
    spark.range(100).withColumn("k", F.col("id") % 3).write.partitionBy("k").parquet(str(tmp_path / "parted"))
    row_groups.rechunk(spark, str(tmp_path / "parted"), str(tmp_path / "whole"), 8)
    whole = spark.read.parquet(str(tmp_path / "whole"))
    assert sorted(whole.columns) == ["id", "k"] and whole.filter("k = id % 3").count() == 100


def test_copy_is_used_again_until_its_source_is_newer(spark, clips, tmp_path):
    cache = str(tmp_path / "cache")
    first = row_groups.ensure_small_groups(spark, clips, cache)
    assert first == row_groups.cache_path(clips, cache) and spark.read.parquet(first).count() == 3000
    made = places.modified(spark, f"{first}/_SUCCESS")
    assert row_groups.ensure_small_groups(spark, clips, cache) == first and places.modified(spark, f"{first}/_SUCCESS") == made
    assert row_groups.ensure_small_groups(spark, clips, cache, group_rows=4000) == clips
    (name,) = [n for n in os.listdir(clips) if n.endswith(".parquet")]
    os.utime(f"{clips}/{name}", (made / 1000 + 10, made / 1000 + 10))
    assert row_groups.ensure_small_groups(spark, clips, cache) == first and places.modified(spark, f"{first}/_SUCCESS") > made
    assert os.listdir(cache) == [os.path.basename(first)]


def test_interrupted_copy_leaves_the_old_one(spark, clips, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    first = row_groups.ensure_small_groups(spark, clips, cache)
    spark.range(9000).coalesce(1).withColumn("x", F.col("id")).write.mode("overwrite").parquet(clips)

    def broken(spark, source, target, group_rows):
        spark.range(5).write.parquet(target)
        raise RuntimeError("lost")

    monkeypatch.setattr(row_groups, "rechunk", broken)
    with pytest.raises(RuntimeError):
        row_groups.ensure_small_groups(spark, clips, cache)
    assert spark.read.parquet(first).count() == 3000 and os.listdir(cache) == [os.path.basename(first)]


def test_no_copy_without_room(spark, clips, tmp_path, caplog):
    assert row_groups.ensure_small_groups(spark, clips, str(tmp_path / "cache"), spare=1e15) == clips
    assert "are free" in caplog.text


def test_cached_groups():
    assert [row_groups.cached_groups(a, g) for a, g in ((4, 10), (0, 10), (4, 2))] == [4, 1, 2]


def read_rows(df):
    """How many rows the scan of ``df`` gave its filter, after groups and pages were passed over."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_access_by_key_reads_few_rows(spark, tmp_path):
    path = str(tmp_path / "clustered")
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_000).alias("id"), F.md5(F.col("id").cast("string")).alias("x"))
    row_groups.write_clustered(df, path, "id", files=4, group_rows=2000)
    groups = row_groups.footers(spark, path)
    assert groups.agg(F.max("rows")).first()[0] <= 2000 and groups.select("file").distinct().count() == 4
    one = row_groups.rows_of(spark, path, "id", [12_345], ["x"])
    assert one.collect()[0]["x"] == df.filter("id = 12345").first()["x"]
    assert read_rows(one) <= row_groups.PAGE_ROWS * 2
    some = row_groups.rows_of(spark, path, "id", [5, 20_000, 39_999, 50_000])
    assert some.count() == 3 and read_rows(row_groups.rows_of(spark, path, "id", [5, 20_000, 39_999, 50_000])) <= 3 * 2 * row_groups.PAGE_ROWS


def test_keys_that_repeat_lie_together(spark, tmp_path):
    path = str(tmp_path / "repeated")
    row_groups.write_clustered(spark.range(5000).select((F.col("id") % 50).alias("k")), path, "k", files=3, group_rows=500)
    assert row_groups.rows_of(spark, path, "k", [7]).count() == 100
    assert read_rows(row_groups.rows_of(spark, path, "k", [7])) <= 100 + 2 * row_groups.PAGE_ROWS
