"""Experts, column names and the rounding that both engines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order matters: of equal scores, the earlier expert counts as the better one.
EXPERTS = ("hubert", "whisper", "w2v2")
#: Aliases that configuration files use for column prefixes.
ALIASES = {"hubert": "hubert", "whisper": "whisper", "wav2vec2": "w2v2", "w2v2": "w2v2"}
SCORES = tuple(f"{e}_wer" for e in EXPERTS)

CLIP_SCHEMA = T.StructType(
    [
        T.StructField("ground_truth", T.StringType()),
        *[T.StructField(f"{e}_features", T.ArrayType(T.ArrayType(T.FloatType()))) for e in ("whisper", "hubert", "w2v2")],
        *[T.StructField(f"{e}_transcription", T.StringType()) for e in ("whisper", "hubert", "w2v2")],
        *[T.StructField(f"{e}_wer", T.DoubleType()) for e in ("whisper", "hubert", "w2v2")],
    ]
)


def score_array(experts: tuple[str, ...] = EXPERTS) -> Column:
    return F.array(*[F.col(f"{e}_wer") for e in experts])


def rounded(x: Column, places: int) -> Column:
    """Half away from zero on the scaled double, and no negative zero: the same value in other engines."""
    scale = F.lit(10.0**places)
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / scale + F.lit(0.0)


def by_expert(df: DataFrame, keep: list[str], experts: tuple[str, ...] = EXPERTS) -> DataFrame:
    """One row for each row and expert: ``keep``, expert, expert_idx, wer."""
    rows = F.array(*[F.struct(F.lit(e).alias("expert"), F.lit(i).alias("expert_idx"), F.col(f"{e}_wer").alias("wer")) for i, e in enumerate(experts)])
    return df.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")
