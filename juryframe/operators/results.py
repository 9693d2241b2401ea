"""A table of results that is filled unit by unit and goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juryframe.sources import places

UNIT = "unit"
LONG = "split string, metric string, value double"


def finished(spark: SparkSession, path: str) -> set[str]:
    """Units whose rows are there: a unit's folder is moved into place when it is whole."""
    fs, at = places.place(spark, path)
    if not fs.exists(at):
        return set()
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return {unquote(n.removeprefix(f"{UNIT}=")) for n in names if n.startswith(f"{UNIT}=")}


def fill(spark: SparkSession, path: str, units: Iterable[str], work: Callable[[str], DataFrame], *, again: Iterable[str] = ()) -> list[str]:
    """Works out every unit that is not finished, and those of ``again``; gives back which it did.

    ``work`` gives a unit's rows (split, metric, value). They replace the unit's partition and no other, when all of them are written; a run that
    is interrupted leaves the unit as it was, and the next one takes it up. A unit without rows counts as not finished.
    """
    known, redo, done = finished(spark, path), set(again), []
    for unit in units:
        if unit in known and unit not in redo:
            continue
        rows = work(unit).select("split", "metric", F.col("value").cast("double").alias("value"), F.lit(unit).alias(UNIT))
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(UNIT).parquet(path)
        done.append(unit)
    return done


def fill_together(spark: SparkSession, path: str, units: Iterable[str], work: Callable[[list[str]], DataFrame]) -> list[str]:
    """Works out all units that are not finished in one pass over their common source; gives back which.

    ``work`` gives the rows (unit, split, metric, value) of a list of units. Else as ``fill``: a run that is interrupted leaves units whole or not
    finished.
    """
    known = finished(spark, path)
    left = [u for u in dict.fromkeys(units) if u not in known]
    if left:
        rows = work(left).select("split", "metric", F.col("value").cast("double").alias("value"), UNIT)
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(UNIT).parquet(path)
    return left


def read(spark: SparkSession, path: str) -> DataFrame:
    """(unit, split, metric, value) of all finished units."""
    return spark.read.schema(f"{LONG}, {UNIT} string").parquet(path).select(UNIT, "split", "metric", "value")


def long(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A row (keys, metric, value) for each of the columns ``metrics``; nulls are left out."""
    return wide.unpivot(keys, metrics, "metric", "value").filter("value is not null")
