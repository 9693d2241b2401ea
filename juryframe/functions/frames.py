"""Sequences of frames: arrays of equally long arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truncate(frames: Column, longest: int) -> Column:
    return F.slice(frames, 1, longest)


def n_frames(frames: Column) -> Column:
    return F.size(frames)


def valid_length(samples: Column, hop: int = 320, longest: int = 1500) -> Column:
    return F.least(F.lit(longest).cast("long"), F.floor(samples / F.lit(hop)))


def valid_length_legacy(samples: Column, rate: int = 16000, per_second: int = 50) -> Column:
    return F.floor(samples / F.lit(float(rate)) * per_second)


def pad(frames: Column, to: Column, width: int) -> Column:
    """``frames`` followed by zero frames up to ``to``."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    return F.concat(frames, F.array_repeat(zero, F.greatest(to - F.size(frames), F.lit(0))))


def mask(frames: Column, to: Column) -> Column:
    """True where a padded sequence holds a frame of its own."""
    return F.transform(F.sequence(F.lit(0), to - 1), lambda t: t < F.size(frames))


def split_at(frames: Column, position: Column) -> tuple[Column, Column]:
    return F.slice(frames, F.lit(1), position), F.slice(frames, position + 1, F.greatest(F.size(frames) - position, F.lit(0)))


def position_code(t: Column, width: int) -> Column:
    """The sinusoidal code of place ``t``: sines in even places, cosines in odd ones."""
    angle = lambda i: t * F.exp(F.floor(i / 2) * 2 * F.lit(-9.210340371976184 / width))  # noqa: E731  ln 10000
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


def positions(length: int, width: int) -> Column:
    """The codes of places 0 to ``length`` - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: position_code(t, width))


def exploded(df: DataFrame, key: str, frames: str) -> DataFrame:
    """(key, t, d, x) for each number."""
    return df.select(key, F.posexplode(frames).alias("t", "frame")).select(key, "t", F.posexplode("frame").alias("d", "x"))


def mean_pool(df: DataFrame, key: str, frames: str) -> DataFrame:
    """(key, d, mean) over the time axis; partial sums are made where the frames lie."""
    return exploded(df, key, frames).groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def pooled_vector(frames: Column, width: int) -> Column:
    """The masked mean inside a row: the sum over frames, by at least one."""
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(frames, zero, lambda s, f: F.zip_with(s, f, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(frames), F.lit(1)))


def offsets(df: DataFrame, key: str, length: str, ranges: int = 1024) -> DataFrame:
    """``df`` with offset: where each row's values begin in the concatenation of all rows in order of ``key``, an integer.

    Rows are summed by ranges of the key first; only the sums of ranges are ordered globally, rows within their range.
    """
    span = df.agg(F.min(key).alias("__low"), (F.max(key) - F.min(key) + 1).alias("__span"))  # one row
    ranged = df.join(F.broadcast(span), how="cross").withColumn("__range", F.floor((F.col(key) - F.col("__low")) / F.col("__span") * ranges))
    sums = ranged.groupBy("__range").agg(F.sum(length).alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))  # at most ``ranges`` rows
    within = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("offset", F.coalesce(F.sum(length).over(within), F.lit(0)))
    return placed.join(F.broadcast(starts), "__range").withColumn("offset", F.col("offset") + F.col("__start")).drop("__low", "__span", "__range", "__start")
