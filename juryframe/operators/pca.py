"""Principal components whose signs are fixed, so that two runs, or two engines, agree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axes:
    """The mean and the first components of a set of vectors, a component a row, with their variances."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, x): the sums of products of numbers i and j of a task's vectors, of number j with i -1, and their count at (-1, -1)."""
    total = None
    for batch in batches:
        vectors = batch.column(0).drop_null()
        if not len(vectors):
            continue
        flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        points = np.hstack([np.ones((len(vectors), 1)), flat.reshape(len(vectors), -1)])
        total = points.T @ points if total is None else total + points.T @ points
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array((x - 1).ravel().astype(np.int32)) for x in (i, j)] + [pa.array(total.ravel())], names=["i", "j", "x"])


def fit(df: DataFrame, vector: str, k: int = 2) -> Axes:
    """The axes of all vectors, which are equally long; null ones are passed over.

    One aggregation adds up the products of every two numbers where the vectors lie. What comes to the driver has width * width numbers,
    whatever the rows. Of a component, the number of largest size is positive (of equals the first).
    """
    sums = df.select(vector).mapInArrow(_sums, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    if not sums:
        raise ValueError("there is no vector to find axes of")
    width = max(r["i"] for r in sums) + 1
    total = np.zeros((width + 1, width + 1))
    for r in sums:
        total[r["i"] + 1, r["j"] + 1] = r["x"]
    n, mean = total[0, 0], total[0, 1:] / total[0, 0]
    scatter = total[1:, 1:] - n * np.outer(mean, mean)
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
    components = vectors[:, ::-1][:, :k].T
    largest = components[np.arange(len(components)), np.abs(components).argmax(axis=1)]
    return Axes(mean, components * np.where(largest < 0, -1.0, 1.0)[:, None], np.maximum(values[::-1][:k], 0) / max(n - 1, 1))


def project(vector: Column, axes: Axes) -> Column:
    """The vector's coordinates along the axes: an array of doubles, worked out inside the JVM."""
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    centred = F.zip_with(vector, numbers(axes.mean), lambda x, m: x.cast("double") - m)
    along = lambda c: F.aggregate(F.zip_with(centred, numbers(c), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return F.when(vector.isNotNull(), F.array(*[along(c) for c in axes.components]))


def principal_axes(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """``df`` with pca: each vector's coordinates along the first ``k`` components of all."""
    return df.withColumn("pca", project(F.col(vector), fit(df, vector, k)))
