"""Exact-size splits and reproducible random numbers, both from hashes of the row's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test", "all")
#: Ranges of the hash; their counts are the only thing that is ordered globally.
RANGES = 65536


def hash_of(key: Column, seed: int) -> Column:
    """Hex digest of seed and id; a null id counts as an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on seed and id alone."""
    return F.conv(F.substring(hash_of(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ranked(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with rn, its place from 1 in order of hash and id, and n_total.

    Rows are ordered within ranges of the hash only; a range's first place is the count of all rows in lower ranges. The
    table of ranges has at most RANGES rows, so it is broadcast.
    """
    digest = hash_of(F.col(key), seed)
    # Bytes have the order of their digits and are half as many to move.
    hashed = df.withColumns({"__h": F.unhex(digest), "__range": F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")})
    counts = hashed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    below = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("n_total"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__h", key))
    # Every range is there; a left join spares the check, made at the scan, that a row's hash is not null.
    return hashed.join(F.broadcast(starts), "__range", "left").withColumn("rn", (F.col("__start") + place).cast("long")).drop("__h", "__range", "__start")


def split(df: DataFrame, key: str, *, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with split: floor(n * train) rows train, floor(n * val) val, the rest test."""
    n_train, n_val = F.floor(F.col("n_total") * F.lit(float(train))), F.floor(F.col("n_total") * F.lit(float(val)))
    name = F.when(F.col("rn") <= n_train, "train").when(F.col("rn") <= n_train + n_val, "val").otherwise("test")
    return ranked(df, key, seed).withColumn("split", name).drop("rn", "n_total")


def select_split(df: DataFrame, name: str) -> DataFrame:
    if name not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, got {name!r}")
    return df if name == "all" else df.filter(F.col("split") == name)


def sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows without replacement, in order of their id."""
    return df.orderBy(hash_of(F.col(key), seed), key).limit(k).orderBy(key)
