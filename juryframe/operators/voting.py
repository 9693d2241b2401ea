"""Combination of hypotheses by a voted word network.

A network is a table of token numbers: a row for each slot, a column for each hypothesis merged so far, and 0 where a
hypothesis has no token in the slot. A hypothesis is merged by an alignment of least cost between slots and tokens; a
token agrees with a slot that holds it in any column. Of equally good alignments, read from their ends, the one
that pairs is preferred to the one that skips a slot, and that to the one that opens a slot. A slot's winner is the
token of the greatest weight, of equals the one in the first column; the gap can win, and is left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = ""


def _aligned(network: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, tokens) of the preferred alignment, place by place; -1 where a side has none.

    The table of least costs is kept as bits, a whole number for each token with a bit for each slot (Hyyrö's form of Myers's algorithm).
    A token agrees with the slots of ``holds``. ``unpaired`` marks places where pairing costs too much, ``rises`` those where a slot skipped costs
    one more, which is where skipping is among the best.
    """
    n, m = len(network), len(tokens)
    holds: dict[int, int] = {}
    for slot, row in enumerate(network.tolist()):
        for token in row:
            holds[token] = holds.get(token, 0) | 1 << slot
    full = (1 << n) - 1
    up, down, unpaired, rises = full, 0, [], []
    for token in tokens.tolist():
        agrees = holds.get(token, 0)
        diagonal = ((((agrees & up) + up) ^ up) | agrees | down) & full
        unpaired.append(diagonal & ~agrees)
        right, left = down | full & ~(diagonal | up), diagonal & up
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | full & ~(diagonal | right), right & diagonal
        rises.append(up)
    i, j, slots, places = n, m, [], []
    while i or j:
        pair = i and j and not unpaired[j - 1] >> (i - 1) & 1
        skip = not pair and i and (not j or rises[j - 1] >> (i - 1) & 1)
        i, j = i - bool(pair or skip), j - (not skip)
        slots.append(i if pair or skip else -1)
        places.append(-1 if skip else j)
    return np.array(slots[::-1], np.int64), np.array(places[::-1], np.int64)


def merge(network: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The network with one column more for ``tokens``."""
    slots, places = _aligned(network, tokens)
    out = np.zeros((len(slots), network.shape[1] + 1), np.int64)
    out[slots >= 0, :-1] = network[slots[slots >= 0]]
    out[places >= 0, -1] = tokens[places[places >= 0]]
    return out


def build(hypotheses: Sequence[np.ndarray], compat: bool = True) -> np.ndarray:
    """The network of all hypotheses, given as token numbers from 1.

    With ``compat`` a hypothesis that meets an empty network starts it anew, so that leading empty hypotheses have no
    column; without, there is a column for each hypothesis.
    """
    network = np.zeros((0, 0), np.int64)
    for k, tokens in enumerate(hypotheses):
        if not len(network):
            network = np.zeros((0, 0 if compat and k else k), np.int64)
        network = merge(network, tokens)
    return network


def vote(network: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """The winning token numbers, without gaps."""
    if not network.size:
        return np.zeros(0, np.int64)
    sums = np.zeros(network.shape)
    for column, weight in zip(network.T, weights, strict=False):
        sums += (network == column[:, None]) * float(weight)
    won = np.take_along_axis(network, sums.argmax(axis=1)[:, None], axis=1).ravel()
    return won[won > 0]


def combine_each(hypotheses: Sequence[str | None], weights: Sequence[Sequence[float]], compat: bool = True) -> list[str]:
    """The voted text under each of ``weights``, of one network; a null hypothesis is the word None, as where texts are made from a column with nulls."""
    numbers: dict[str, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in ("None" if h is None else h).split()], np.int64) for h in hypotheses]
    words, network = [GAP, *numbers], build(coded, compat)
    return [" ".join(words[i] for i in vote(network, w).tolist()) for w in weights]


def combine(hypotheses: Sequence[str | None], weights: Sequence[float], compat: bool = True) -> str:
    return combine_each(hypotheses, [weights], compat)[0]


def combined(hypotheses: Column, weights: Column, compat: bool = True) -> Column:
    """``combine`` over an array of texts and an array of weights."""
    return combined_each(hypotheses, F.array(weights), compat)[0]


def combined_each(hypotheses: Column, weights: Column, compat: bool = True) -> Column:
    """``combine_each`` over an array of texts and an array of arrays of weights."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, shares: pd.Series) -> pd.Series:
        return pd.Series([combine_each(list(t), [list(w) for w in ws], compat) for t, ws in zip(texts, shares, strict=True)], dtype=object)

    return run(hypotheses, weights)


def evaluate(clips: DataFrame, hypotheses: Column, weights: Column, compat: bool = True) -> DataFrame:
    """``clips`` (with ref, an array of tokens) with voted, n_ref, n_hyp, edits and wer."""
    return rated(clips.withColumn("voted", combined(hypotheses, weights, compat)))


def rated(voted: DataFrame) -> DataFrame:
    """``voted`` (with ref and voted) with n_ref, n_hyp, edits and wer."""
    from juryframe.functions.text import tokens, word_distance_udf, word_error_rate

    return (
        voted.withColumn("hyp", tokens(F.col("voted")))
        .withColumns({"n_ref": F.size("ref"), "n_hyp": F.size("hyp"), "edits": word_distance_udf(F.col("ref"), F.col("hyp"))})
        .withColumn("wer", word_error_rate(F.col("edits"), F.col("n_ref"), F.col("n_hyp"), "rover"))
        .drop("hyp")
    )
