"""Tables of results and training curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juryframe.functions.text import without_prefix, without_seed
from juryframe.schema import rounded


def seed_summary(results: DataFrame) -> DataFrame:
    """(label, wer, std, n) from (method, wer): mean and population deviation over seeds, and each seed where there are several.

    Lowest rate first.
    """
    named = results.filter("wer is not null").withColumn("base", without_seed(F.col("method")))
    groups = named.groupBy("base").agg(rounded(F.avg("wer"), 6).alias("wer"), rounded(F.stddev_pop("wer"), 6).alias("std"), F.count(F.lit(1)).alias("n"), F.min("method").alias("only"))
    label = F.concat(F.lit("Model: "), F.when(F.col("n") > 1, F.concat("base", F.lit(" (mean)"))).otherwise(F.col("only")))
    single = F.when(F.col("n") > 1, F.col("std")).otherwise(0.0)
    detail = named.join(groups.filter("n > 1").select("base"), "base").select(F.concat(F.lit("Model: "), "method").alias("label"), rounded(F.col("wer"), 6).alias("wer"), F.lit(0.0).alias("std"), F.lit(1).cast("long").alias("n"))
    return groups.select(label.alias("label"), "wer", single.alias("std"), "n").unionByName(detail).orderBy("wer", "label")


def checkpoint_average(metrics: DataFrame) -> DataFrame:
    """(metric, value) over checkpoints, from (checkpoint, metric, value); the prefix test/ is taken off."""
    return metrics.groupBy(without_prefix(F.col("metric")).alias("metric")).agg(rounded(F.avg(F.col("value").cast("double")), 6).alias("value"))


def top_checkpoints(checkpoints: DataFrame, k: int) -> DataFrame:
    """The ``k`` checkpoints of lowest value, or with ``k`` below 1 the best one."""
    return checkpoints.orderBy("value", "checkpoint").limit(max(1, k))


def numeric_order(df: DataFrame, column: str) -> DataFrame:
    """Rows by the number that a text column holds."""
    return df.orderBy(F.col(column).cast("int"))


def report_rows(documents: DataFrame, fields: dict[str, str], name: Column) -> DataFrame:
    """(method, metric, value) of the nested fields of result documents; fields that are missing are skipped."""
    rows = F.array(*[F.struct(F.lit(label).alias("metric"), F.col(path).cast("double").alias("value")) for label, path in fields.items()])
    return documents.select(name.alias("method"), F.explode(rows).alias("r")).select("method", "r.*").filter("value is not null")


def sweep_series(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """(r, method, value) for each wanted (r, method); null where there is no result. Ordered by r as a number."""
    return wanted.join(results, ["r", "method"], "left").orderBy(F.col("r").cast("int"), "method")
