"""Row-wise choice among experts, and the losses of a router's probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from juryframe.schema import EXPERTS

EPSILON = 1e-8


def oracle_label(experts: tuple[str, ...] = EXPERTS) -> Column:
    """Name of the best expert by chained ``<=``: a null score fails its comparisons, and the last expert takes the rest."""
    label = F.lit(experts[-1])
    for e in reversed(experts[:-1]):
        no_worse = [F.col(f"{e}_wer") <= F.col(f"{o}_wer") for o in experts if o != e]
        test = no_worse[0]
        for t in no_worse[1:]:
            test = test & t
        label = F.when(test, F.lit(e)).otherwise(label)
    return label


def argmin(values: Column) -> Column:
    """Index from 0 of the first least value."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def argmax(values: Column) -> Column:
    """Index from 0 of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def at(values: Column, index: Column) -> Column:
    return F.get(values, index)


def softmax(values: Column) -> Column:
    """Shifted by the greatest value, so that no exponential overflows."""
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(F.array(powers), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))[0]


def soft_target(scores: Column, temperature: float) -> Column:
    return softmax(F.transform(scores, lambda x: -x / F.lit(float(temperature))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def logs(probs: Column) -> Column:
    return F.transform(probs, lambda p: F.log(p + F.lit(EPSILON)))


def soft_cross_entropy(targets: Column, probs: Column) -> Column:
    return -dot(targets, logs(probs))


def log_softmax_of_logs(probs: Column) -> Column:
    """The logs taken as logits: normalised once more, as the small constant leaves their sum above one."""
    total = F.aggregate(probs, F.lit(0.0), lambda s, p: s + p + F.lit(EPSILON))
    return F.transform(probs, lambda p: F.log(p + F.lit(EPSILON)) - F.log(total))


def hard_cross_entropy_terms(scores: Column, probs: Column, weights: Column, smoothing: float) -> tuple[Column, Column]:
    """(loss, weight) of a row; the loss of a set is the ratio of their sums.

    The true class has 1 - smoothing, and smoothing / K goes to every class, each term times its class's weight.
    """
    lp, label, k = log_softmax_of_logs(probs), argmin(scores), F.size(probs)
    own = F.get(weights, label)
    even = dot(weights, lp) / k
    return -(F.lit(1.0 - smoothing) * own * F.get(lp, label) + F.lit(float(smoothing)) * even), own


def learning_rate_factor(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.lit(0.5) * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
