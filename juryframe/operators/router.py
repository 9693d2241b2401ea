"""A pooled multi-layer router: mean of each expert's frames, two layers, softmax."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass
class Weights:
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    @classmethod
    def seeded(cls, width: int, hidden: int, classes: int, seed: int = 42) -> Weights:
        """Xavier-uniform weights and zero biases."""
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.uniform(-1, 1, (a, b)) * math.sqrt(6 / (a + b))
        return cls(draw(width, hidden), np.zeros(hidden), draw(hidden, classes), np.zeros(classes))


_erf = np.vectorize(math.erf, otypes=[float])


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def probabilities(x: np.ndarray, w: Weights) -> np.ndarray:
    z = gelu(x @ w.first + w.first_bias) @ w.second + w.second_bias
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def route(spark: SparkSession, pooled: Column, weights: Weights) -> Column:
    """Routing probabilities of pooled vectors; the weights, whose size is the model's own, are sent once to each worker."""
    sent = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(probabilities(np.stack(vectors.to_numpy()).astype(float), sent.value)))

    return run(pooled)
