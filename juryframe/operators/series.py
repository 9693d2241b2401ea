"""Long ordered series: places of rows, and windows over them, without a task that holds a whole series.

A series is cut into ranges of its order, whose counts say where each range begins; rows are ordered within a range
only. A window then works on blocks of consecutive places, and each block gets the few rows beside it (its halo) as copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(df: DataFrame, column: str) -> Column:
    """A column as a number in the same order; times as seconds."""
    x, kind = F.col(column), df.schema[column].dataType.typeName()
    if kind == "timestamp":
        return x.cast("double")
    if kind == "timestamp_ntz":  # by its fields, as a time zone might set clocks back
        return F.unix_date(x.cast("date")) * 86400 + F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)
    return x


def placed(df: DataFrame, group: list[str], order: list[str], span: float, place: str = "place") -> DataFrame:
    """``df`` with ``place``: each row's number from 0 among the rows of its ``group``, by ``order``.

    ``span`` is the width of a range of the first order column, a number or a time (then in seconds). A range is one task's, so
    it should hold many rows, but not more than a task can sort. Rows that tie throughout have one of their places each. Nulls
    come first. Only the counts of ranges, a row for each range of a group, are ordered over a whole group.
    """
    ranged = df.withColumn("__range", F.floor(_number(df, order[0]) / F.lit(span)))
    counts = ranged.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(F.col("__range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__range").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1
    same = F.col("__range").eqNullSafe(F.col("__at"))
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    numbered = ranged.withColumn("__own", own)
    return numbered.join(starts, same).withColumn(place, (F.col("__start") + F.col("__own")).cast("long")).select(*df.columns, place)


def with_halo(df: DataFrame, place: str, block: int, before: int, after: int) -> DataFrame:
    """Rows with ``__block`` and ``__own``: every block of ``block`` places has its own rows and copies of ``before`` and ``after`` others.

    A row is copied only where it lies so near to a block's end, so copies are some (before + after) / block of all rows.
    """
    at = F.col(place)
    blocks = F.sequence(F.greatest(F.floor((at - after) / block), F.lit(0)), F.floor((at + before) / block))
    dealt = df.withColumn("__block", F.explode(blocks))
    return dealt.withColumn("__own", F.col("__block") == F.floor(at / block))


def moving_average(
    series: DataFrame, window: int, group: list[str], step: str = "step", value: str = "value", *, place: str | None = None, span: float = 1 << 18, block: int = 1 << 16
) -> DataFrame:
    """``series`` with smooth: a centred mean over ``window`` rows in order of ``step``, which counts what lies outside as 0.

    Series shorter than the window, and a window of 1, stay as they are; null values count as 0. ``place`` names a column that numbers
    each series' rows from 0 without gaps; without one, rows are placed by ranges of ``span`` steps. No task holds more than ``block``
    rows of a series and their halo, however long it is.
    """
    if window <= 1:
        return series.withColumn("smooth", F.col(value))
    block = max(block, window)
    at = place or "__place"
    numbered = series if place else placed(series, group, [step], span, at)
    back, ahead = window // 2, (window - 1) // 2
    dealt = with_halo(numbered, at, block, back, ahead)
    rows = Window.partitionBy(*group, "__block")
    around = rows.orderBy(at).rowsBetween(-back, ahead)
    # A block other than the first has as many rows before it, so only the first can be all of a short series.
    short = (F.col("__block") == 0) & (F.count(F.lit(1)).over(rows) < window)
    smooth = F.when(short, F.col(value)).otherwise(F.coalesce(F.sum(value).over(around), F.lit(0.0)) / F.lit(float(window)))
    return dealt.withColumn("smooth", smooth).filter("__own").select(*series.columns, "smooth")

