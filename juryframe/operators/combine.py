"""Putting tables together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juryframe.schema import ALIASES


def assemble(tables: dict[str, DataFrame], key: str, *, truth_from: str = "whisper", truth: str = "ground_truth") -> DataFrame:
    """Expert tables joined on ``key``: the truth of one of them and every expert's own columns.

    Rows are matched by key, never by place. Tables that don't hold the same keys raise when the result is computed.
    """
    own = [df if e == truth_from else df.drop(truth) for e, df in tables.items()]
    marked = [df.withColumn(f"__{i}", F.lit(True)) for i, df in enumerate(own)]
    joined = reduce(lambda a, b: a.join(b, key, "full"), marked)
    there = reduce(lambda a, b: a & b, [F.col(f"__{i}").isNotNull() for i in range(len(own))])
    checked = F.when(there, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("expert tables differ at key "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(dict(own[0].dtypes)[key]))
    return joined.withColumn(key, checked).drop(*[f"__{i}" for i in range(len(own))])


def assemble_keeping_first(tables: list[DataFrame], key: str) -> DataFrame:
    """Joined on ``key``; of columns with one name the first table's stays."""
    out = tables[0]
    for df in tables[1:]:
        out = out.join(df.drop(*[c for c in df.columns if c != key and c in out.columns]), key)
    return out


def stack_rows(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def prefixed(df: DataFrame, alias: str, key: str = "clip_id") -> DataFrame:
    """An expert's own generic columns (features, transcription, wer) under the prefix of its alias, as the clip table has them."""
    return df.select(key, *[F.col(c).alias(f"{ALIASES[alias]}_{c}") for c in ("features", "transcription", "wer") if c in df.columns])


def override(shared: Column, own: Column) -> Column:
    """The settings (maps) that all variants share, with a variant's own ones in place of those of the same name."""
    return F.map_concat(F.map_filter(shared, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)


def variant_grid(datasets: DataFrame, experts: list[str]) -> DataFrame:
    """(dataset, expert) of all different datasets and known experts; unknown aliases are left out, none left is an error."""
    known = [e for e in experts if e in ALIASES]
    if not known:
        raise ValueError("no known expert is left")
    return datasets.select("dataset").distinct().select("dataset", F.explode(F.array(*[F.lit(e) for e in known])).alias("expert"))


def expand_seeds(methods: DataFrame) -> DataFrame:
    """A row for each of a method's ``seeds``, its name with the seed as suffix; without seeds the method stays one row."""
    rows = methods.select("*", F.explode_outer("seeds").alias("seed"))
    return rows.withColumn("method", F.when(F.col("seed").isNull(), F.col("method")).otherwise(F.concat("method", F.lit("-seed"), "seed"))).drop("seeds")
