"""Half-precision numbers agree with NumPy's."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from juryframe.sources import clip_files, halves


def every_half():
    return np.arange(65536, dtype=np.uint16).view(np.float16)


def numbers():
    """All finite halves, their neighbours as floats, the places half-way between them, powers of two, and random floats."""
    own = every_half()
    own = np.sort(own[np.isfinite(own)].astype(np.float64))
    middle = (own[1:] + own[:-1]) / 2
    rng = np.random.default_rng(5)
    wide = (rng.normal(size=4000) * 10.0 ** rng.integers(-9, 6, 4000)).astype(np.float32).astype(np.float64)
    powers = 2.0 ** np.arange(-30, 18)
    near = np.concatenate([np.nextafter(middle.astype(np.float32), np.float32(s), dtype=np.float32) for s in (-1e9, 1e9)]).astype(np.float64)
    return np.concatenate([own, middle, wide, powers, -powers, near, [65519.999, 65520.0, 1e300, -1e300, 0.0]])


def test_rounding_is_to_nearest_even(spark):
    x = numbers()
    with np.errstate(over="ignore"):
        want = x.astype(np.float16)
    df = spark.createDataFrame(pa.table({"i": np.arange(len(x)), "x": x}).to_pandas())
    found = df.select("i", halves.rounded_half(F.col("x")).alias("r"), halves.half_bits(F.col("x")).alias("b")).orderBy("i").toPandas()
    assert np.array_equal(found["r"].to_numpy(), want.astype(np.float64))
    assert np.array_equal(found["b"].to_numpy().astype(np.uint16), np.where(want == 0, np.float16(0), want).view(np.uint16))


def test_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    found = df.select(halves.rounded_half(F.col("x")).alias("r"), halves.half_bits(F.col("x")).alias("b")).collect()
    assert found[0]["r"] is None and found[0]["b"] is None and found[1]["r"] != found[1]["r"] and found[1]["b"] == 32256


def test_every_two_bytes_decode(spark):
    want = every_half()
    df = spark.createDataFrame([(i, bytearray(want[i : i + 1].tobytes())) for i in range(0, 65536, 7)], "i int, b binary")
    found = df.select("i", halves.half_value(F.col("b")).alias("v"), halves.decode_half(F.array(F.array("b")))[0][0].alias("w")).collect()
    for r in found:
        assert np.array_equal([r["v"], r["w"]], [float(want[r["i"]])] * 2, equal_nan=True)


def test_arrays_round_trip(spark):
    rng, rows = np.random.default_rng(6), []
    for n, width in ((0, 0), (1, 3), (5, 4), (3, 0)):
        rows.append(([[float(v) for v in rng.normal(size=width).astype(np.float16)] for _ in range(n)],))
    rows += [(None,), ([None, [1.0]],)]
    df = spark.createDataFrame(rows, "f array<array<float>>").coalesce(1)
    stored = df.select("f", halves.encode_half(F.col("f")).alias("s"))
    assert [r[0] for r in stored.select(halves.decode_half(F.col("s"))).collect()] == [r[0] for r in rows]
    assert [r[0] for r in stored.limit(3).filter("size(f) > 1").select(halves.decode_half(F.col("s"))).collect()] == [rows[2][0]]


def test_files_of_halves(spark, tmp_path):
    path = str(tmp_path / "half.parquet")
    values = [[[1.5, -0.25], [65504.0, 6e-8]], [[0.0, 3.140625]], None, []]
    kind = pa.list_(pa.list_(pa.float16()))
    column = pa.array([None if row is None else [[np.float16(x) for x in f] for f in row] for row in values], kind)
    pq.write_table(pa.table({"hubert_wer": [0.5, 0.25, 0.75, 1.0], "hubert_features": column}), path)
    found = {r["hubert_wer"]: r["hubert_features"] for r in halves.half_scan(spark, path, ["hubert_features"], "hubert_wer double").collect()}
    for wer, row in zip((0.5, 0.25, 0.75, 1.0), values, strict=True):
        assert found[wer] == (None if row is None else [[np.float32(np.float16(x)) for x in f] for f in row])
    assert clip_files.score_scan(spark, path).agg(F.sum("hubert_wer")).first()[0] == 2.5


@pytest.mark.parametrize("rows", [0, 3])
def test_written_halves_are_read_like_others(spark, tmp_path, rows):
    path = str(tmp_path / "own")
    df = spark.range(rows).select("id", F.array(F.array((F.col("id") / 3).cast("float"))).alias("f"))
    df.select("id", halves.encode_half(F.col("f")).alias("f")).write.parquet(path)
    found = halves.half_scan(spark, path, ["f"], "id long").collect()
    assert {r["id"]: r["f"][0][0] for r in found} == {i: float(np.float16(np.float32(i / 3))) for i in range(rows)}
