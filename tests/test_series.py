"""Long series in blocks agree with series held as a whole."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from juryframe.operators import series


@pytest.fixture(scope="module")
def rows():
    """Two long series and short ones, steps with gaps, bunches and negative numbers, nulls among group, step and value."""
    rng, out = random.Random(1), []
    for run, n in (("a", 500), ("b", 333), ("c", 3), (None, 40), ("d", 1)):
        steps = rng.sample(range(-200, 5000), n)
        out += [(run, s, rng.uniform(-1, 1)) for s in steps]
    return out + [("a", None, 5.0), ("c", 9000, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "run string, step long, value double").repartition(5)


def ordered(rows, run):
    return sorted((r for r in rows if r[0] == run), key=lambda r: (r[1] is not None, r[1] or 0))


@pytest.mark.parametrize("span", [1, 7.5, 64, 1e6])
def test_places(spark, rows, span):
    found = series.placed(frame(spark, rows), ["run"], ["step"], span).collect()
    for run in ("a", "b", "c", "d", None):
        mine = sorted((r for r in found if r["run"] == run), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(len(mine)))
        assert [r["step"] for r in mine] == [r[1] for r in ordered(rows, run)]


def test_places_by_time_and_ties(spark):
    at = datetime.datetime(2024, 10, 27, 0, 30)
    rows = [("x", at + datetime.timedelta(minutes=17 * (i // 2)), 100 - i) for i in range(60)]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, f"run string, ts {kind}, id int").repartition(3)
        found = series.placed(df, ["run"], ["ts", "id"], 3600.0).orderBy("place").collect()
        assert [(r["ts"], r["id"]) for r in found] == sorted((r[1], r[2]) for r in rows)
        assert [r["place"] for r in found] == list(range(60))


@pytest.mark.parametrize("window", [1, 2, 3, 4, 5, 16, 41])
@pytest.mark.parametrize("numbered", [False, True])
def test_moving_average(spark, rows, window, numbered):
    df, place = frame(spark, rows), None
    if numbered:
        df, place = series.placed(df, ["run"], ["step"], 100.0, "at"), "at"
    found = series.moving_average(df, window, ["run"], place=place, span=50, block=16)
    assert found.columns == [*df.columns, "smooth"]
    found = found.collect()
    assert len(found) == len(rows)
    for run in ("a", "b", "c", "d", None):
        mine = ordered(rows, run)
        values = [r[2] for r in mine]
        if window > 1 and len(mine) >= window:
            values = np.convolve([v or 0.0 for v in values], np.ones(window) / window, mode="same")[: len(mine)]
        got = {r["step"]: r["smooth"] for r in found if r["run"] == run}
        for r, v in zip(mine, values, strict=True):
            assert got[r[1]] == (None if v is None else pytest.approx(v, abs=1e-12))


def test_no_task_holds_a_series(spark):
    """Of one series in many blocks, a block has its own rows and its halo."""
    df = series.placed(spark.range(1000).select(F.lit("a").alias("run"), F.col("id").alias("step"), F.lit(1.0).alias("value")), ["run"], ["step"], 100)
    sizes = series.with_halo(df, "place", 64, 3, 2).groupBy("__block").agg(F.count(F.lit(1)).alias("n"), F.count_if("__own").alias("own")).orderBy("__block").collect()
    assert [r["own"] for r in sizes if r["own"]] == [64] * 15 + [40]
    assert max(r["n"] for r in sizes) == 64 + 5
    windows = series.moving_average(df, 5, ["run"], place="place", block=64)._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" in windows and "Window" in windows


def test_empty(spark):
    assert series.moving_average(frame(spark, []), 5, ["run"]).count() == 0
