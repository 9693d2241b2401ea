"""Dense layers as array expressions over a one-row table of weights: a router that runs inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from juryframe.functions.choice import softmax
from juryframe.functions.frames import exploded

LAYERS = "array<struct<kernel: array<array<double>>, bias: array<double>>>"


def pool_experts(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, pooled): the mean frame of every expert, one after another, from sequences in parts.

    Means are made of sums where the frames lie; an expert without frames for a key leaves its place out. A group holds one number for each
    dimension of all experts.
    """
    rows = [exploded(p, key, "frames").select(key, F.lit(i).alias("e"), "d", F.col("x").cast("double").alias("x")) for i, p in enumerate(parts.values())]
    both = rows[0]
    for r in rows[1:]:
        both = both.union(r)
    means = both.groupBy(key, "e", "d").agg(F.avg("x").alias("mean"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("e", "d", "mean"))), lambda m: m["mean"]).alias("pooled"))


def layers_table(spark: SparkSession, layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """One row: ``layers``, the (kernel, bias) of each layer; a kernel has a row for each output."""
    row = [{"kernel": [[float(x) for x in w] for w in kernel], "bias": [float(b) for b in bias]} for kernel, bias in layers]
    return spark.createDataFrame([(row,)], f"layers {LAYERS}")


def waves(sizes: Sequence[int]) -> Column:
    """Layers of the given sizes with weights from sines, the same in any engine; biases are 0.

    The weight from input i to output o of layer n is sin(13 o + 7 i + n) * sqrt(6 / (inputs + outputs)).
    """
    upto = lambda k: F.sequence(F.lit(0), F.lit(k - 1))

    def layer(n: int, ins: int, outs: int) -> Column:
        scale = F.lit(float(np.sqrt(6 / (ins + outs))))
        weights = lambda o: F.transform(upto(ins), lambda i: F.sin((13 * o + 7 * i + n).cast("double")) * scale)
        return F.struct(F.transform(upto(outs), weights).alias("kernel"), F.array_repeat(F.lit(0.0), outs).alias("bias"))

    return F.array(*[layer(n, *ends) for n, ends in enumerate(zip(sizes[:-1], sizes[1:], strict=True))])


def _bound(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def erf(x: Column) -> Column:
    """The error function, by its series of positive terms: each is 2 x x / (2 n + 1) times the one before."""

    def series(z: Column) -> Column:
        square = 2 * z * z
        terms = F.sequence(F.lit(1), (square + 12 * F.abs(z) + 20).cast("int"))
        found = F.aggregate(
            terms, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), lambda s, n: _bound(s["term"] * square / (2 * n + 1), lambda t: F.struct(t.alias("term"), (s["total"] + t).alias("total")))
        )
        return found["total"] * F.exp(-z * z) * z * F.lit(2 / float(np.sqrt(np.pi)))

    return F.when(F.abs(x) > 6, F.signum(x)).otherwise(_bound(x, series))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / F.lit(float(np.sqrt(2)))))


def dense(x: Column, layer: Column) -> Column:
    """The layer's outputs for the vector ``x``."""
    one = lambda w, b: F.aggregate(F.zip_with(x, w, lambda v, u: v * u), b, lambda s, p: s + p)
    return F.zip_with(layer["kernel"], layer["bias"], one)


def route(x: Column, layers: Column, n_layers: int) -> Column:
    """Routing probabilities of the vector ``x``: every layer but the last with the GELU, then the softmax."""
    if n_layers < 1:
        raise ValueError("a router has at least one layer")

    def after(v: Column, n: int) -> Column:
        out = dense(v, F.get(layers, F.lit(n)))
        if n == n_layers - 1:
            return _bound(out, softmax)
        return _bound(F.transform(out, gelu), lambda h: after(h, n + 1))

    return after(x, 0)
