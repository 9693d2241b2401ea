"""An extension: mean scores and oracle frequencies of a stream of clips, by window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juryframe.functions.choice import argmin
from juryframe.schema import EXPERTS, score_array


def scoreboard(clips: DataFrame, *, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, n, means, frequencies) for each window; rows that come later than ``late`` are left out.

    Works on a stream and on a table. State is one row of sums a window.
    """
    label = argmin(score_array())
    return (
        clips.withWatermark(time, late)
        .groupBy(F.window(time, width))
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"{e}_wer").alias(f"{e}_mean") for e in EXPERTS], *[F.avg((label == i).cast("double")).alias(f"{e}_share") for i, e in enumerate(EXPERTS)])
        .select(F.col("window.start").alias("start"), "n", *[f"{e}_{k}" for k in ("mean", "share") for e in EXPERTS])
    )
