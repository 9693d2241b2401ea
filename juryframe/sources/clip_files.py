"""Files of clips: scans, metadata, results and audio rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from juryframe.schema import EXPERTS
from juryframe.sources import row_groups


def scan(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet scan that reads only ``columns``."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def scan_sql(spark: SparkSession, path: str, columns: str = "*", where: str = "true") -> DataFrame:
    """A query straight over a file."""
    return spark.sql(f"SELECT {columns} FROM parquet.`{path}` WHERE {where}")


def corpus_glob(root: str, subset: str, split: str) -> str:
    """Where a corpus keeps the Parquet files of a subset's split."""
    return f"{root}/{subset}/{split}/*.parquet"


def score_scan(spark: SparkSession, path: str) -> DataFrame:
    """Only the scores. The schema is stated, so features of a type that Spark does not know are never looked at."""
    return spark.read.schema(T.StructType([T.StructField(f"{e}_wer", T.DoubleType()) for e in EXPERTS])).parquet(path)


def file_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """Key and value metadata of a Parquet file; of a table, of its first file."""
    first = row_groups.files(spark, path).agg(F.min("path")).first()[0]
    if first is None:
        return {}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(first), conf))
    try:
        return dict(reader.getFooter().getFileMetaData().getKeyValueMetaData())
    finally:
        reader.close()


def write_metadata(spark: SparkSession, path: str, values: dict) -> None:
    """Metadata beside a clip table, as one row a key; Spark's writer takes none of its own into the footer."""
    spark.createDataFrame([(k, json.dumps(v)) for k, v in values.items()], "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}_meta")


def read_metadata(spark: SparkSession, path: str) -> dict:
    return {r["key"]: json.loads(r["value"]) for r in spark.read.schema("key string, value string").json(f"{path}_meta").collect()}


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested result documents, each a JSON file."""
    return spark.read.option("multiLine", True).json(path)


def write_results(df: DataFrame, path: str, method: str) -> None:
    """A method's results under their own folder, replaced when the method is run again."""
    df.write.mode("overwrite").json(f"{path}/method={method}")


def long_audio(df: DataFrame, samples: str = "audio.array", least: int = 1600) -> DataFrame:
    """Rows with more than ``least`` samples."""
    return df.filter(F.size(samples) > least)


def some_audio(df: DataFrame, samples: str = "audio.array") -> DataFrame:
    """Rows with audio that is neither null nor empty."""
    return df.filter(F.col(samples).isNotNull() & (F.size(samples) > 0))
