"""Known corpora, processed tables, legacy record indexes and step tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from juryframe.sources.clip_files import corpus_glob


@dataclass(frozen=True)
class Corpus:
    subset: str
    split: str = "test"
    text_column: str = "text"


#: Subsets, splits and text columns of the three corpora.
CORPORA = {
    "ami": Corpus("ihm"),
    "libri": Corpus("other"),
    "voxpopuli": Corpus("en_accented", text_column="normalized_text"),
}


def read_corpus(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Audio rows of a known corpus under ``root``, the reference text as ``text``."""
    if name not in CORPORA:
        raise ValueError(f"corpus must be one of {sorted(CORPORA)}, got {name!r}")
    corpus = CORPORA[name]
    return spark.read.parquet(corpus_glob(root, corpus.subset, corpus.split)).withColumnRenamed(corpus.text_column, "text")


def processed_path(name: str, known: dict[str, tuple[str, str]], source: str | None = None, target: str | None = None) -> tuple[str, str]:
    """(source, target) of a processed table: as registered, or as given. An unknown name needs both given."""
    if name not in known and not (source and target):
        raise ValueError(f"{name!r} is not registered; give both its source and its target")
    registered = known.get(name, (None, None))
    return source or registered[0], target or registered[1]


def read_legacy_index(spark: SparkSession, path: str) -> DataFrame:
    """Records of a metadata document: a JSON array of objects, one for each sample."""
    return spark.read.option("multiLine", True).json(path)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def _matrix(contents: pd.Series) -> pd.Series:
    from io import BytesIO

    return pd.Series([None if c is None else list(np.load(BytesIO(c)).astype(np.float32)) for c in contents])


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(path, frames) of two-dimensional array files, read by Spark; a file is a row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", matrix(F.col("content")).alias("frames"))


def matrix(content: Column) -> Column:
    return _matrix(content)


def read_steps(spark: SparkSession, paths: dict[str, str], tags: Sequence[str]) -> DataFrame:
    """(run, tag, step, value) of step tables by run. A tag that a run lacks gives no rows."""
    out = spark.createDataFrame([], "run string, tag string, step long, value double")
    for run, path in paths.items():
        rows = spark.read.schema("tag string, step long, value double").parquet(path)
        out = out.unionByName(rows.filter(F.col("tag").isin(*tags)).withColumn("run", F.lit(run)))
    return out
