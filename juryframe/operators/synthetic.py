"""A generator of clips whose best expert depends on the order of two regimes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from juryframe.functions.choice import clamp
from juryframe.operators.split import uniform
from juryframe.schema import EXPERTS, by_expert

BEST, WORST = 0.15, 0.50


def regime_table(spark: SparkSession, regimes: int, best: float = BEST, worst: float = WORST) -> DataFrame:
    """(r1, r2, expert_idx, wer) without noise: expert (r1 + 2 r2) mod K is the best. regimes * regimes * K rows."""
    axis = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    cells = spark.range(1).select(axis("r1", regimes)).select("r1", axis("r2", regimes)).select("r1", "r2", axis("expert_idx", len(EXPERTS)))
    own = F.pmod(F.col("r1") + 2 * F.col("r2"), F.lit(len(EXPERTS))) == F.col("expert_idx")
    return cells.withColumn("wer", clamp(F.when(own, best).otherwise(worst), 0.01, 1.0))


def measured(table: DataFrame) -> DataFrame:
    """(r1, r2, expert_idx, wer): each expert's mean score over the clips of two regimes; pairs without clips are left out."""
    long = by_expert(table, ["regime_first", "regime_second"])
    return long.groupBy(F.col("regime_first").alias("r1"), F.col("regime_second").alias("r2"), "expert_idx").agg(F.avg("wer").alias("wer"))


def best_expert(cells: DataFrame) -> DataFrame:
    """(r1, r2, best): the expert of lowest score, of equals the first."""
    return cells.groupBy("r1", "r2").agg(F.min(F.struct("wer", "expert_idx"))["expert_idx"].alias("best"))


def draw(key: str, seed: int, low: int | Column, high: int | Column) -> Column:
    """An integer in [low, high) from the hash of seed and id."""
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return (low + F.floor(uniform(F.col(key), seed) * (high - low))).cast("int")


def clips(ids: DataFrame, regimes: int, length: int, seed: int = 42, best: float = BEST, worst: float = WORST) -> DataFrame:
    """(clip_id, regime_first, regime_second, switch_position, scores) for each of ``ids`` (clip_id): two different regimes and where they change."""
    spark, rows = ids.sparkSession, ids.select("clip_id")
    rows = rows.withColumns({"regime_first": draw("clip_id", seed, 0, regimes), "__other": draw("clip_id", seed + 1, 0, regimes - 1), "switch_position": draw("clip_id", seed + 2, length // 4, 3 * length // 4)})
    rows = rows.withColumn("regime_second", F.when(F.col("__other") >= F.col("regime_first"), F.col("__other") + 1).otherwise(F.col("__other"))).drop("__other")
    cells = regime_table(spark, regimes, best, worst)
    wide = cells.groupBy("r1", "r2").agg(*[F.max(F.when(F.col("expert_idx") == i, F.col("wer"))).alias(f"{e}_wer") for i, e in enumerate(EXPERTS)])
    # The table has regimes * regimes rows.
    return rows.join(F.broadcast(wide), (F.col("regime_first") == F.col("r1")) & (F.col("regime_second") == F.col("r2"))).drop("r1", "r2")


def with_noise(table: DataFrame, key: str, seed: int, deviation: float) -> DataFrame:
    """Scores with normal noise, made from two hashed numbers of each clip, cut to [0, 1]."""
    def noise(i: int) -> Column:
        u, v = (uniform(F.concat(F.col(key).cast("string"), F.lit(f"/{i}{c}")), seed) for c in "uv")
        return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v) * deviation

    return table.withColumns({f"{e}_wer": clamp(F.col(f"{e}_wer") + noise(i), 0.0, 1.0) for i, e in enumerate(EXPERTS)})


def with_frames(table: DataFrame, *, regimes: int, length: int, latent: int = 8, widths: dict[str, int] | None = None, deviation: float = 0.5, seed: int = 42) -> DataFrame:
    """Clips with ``{expert}_features``: each frame is its regime's centre plus noise, projected for the expert.

    Centres and projections come from the seed alone, noise from the seed and the clip's id, so the outcome does not depend on
    how clips are dealt to tasks. Batches are written as they are made.
    """
    widths = widths or dict.fromkeys(EXPERTS, 16)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(regimes, latent)).astype(np.float32)
    maps = {e: (rng.normal(size=(latent, d)) / np.sqrt(latent)).astype(np.float32) for e, d in widths.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column("clip_id").to_pylist()
                first, second, change = (part.column(c).to_numpy() for c in ("regime_first", "regime_second", "switch_position"))
                regime = np.where(np.arange(length)[None, :] < change[:, None], first[:, None], second[:, None])
                noise = np.stack([np.random.default_rng([seed, i]).normal(0, deviation, (length, latent)) for i in ids]) if ids else np.zeros((0, length, latent))
                points = centres[regime] + noise.astype(np.float32)
                arrays = list(part.columns)
                for e, m in maps.items():
                    flat = (points @ m).astype(np.float32)
                    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[2], dtype=np.int32)), pa.array(flat.ravel()))
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, length, dtype=np.int32)), inner))
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, *[f"{e}_features" for e in maps]])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInArrow(run, kinds + "".join(f", {e}_features array<array<float>>" for e in maps))


def sanity(table: DataFrame) -> DataFrame:
    """Mean of the best score, of all scores and of each expert's."""
    scores = [F.col(f"{e}_wer") for e in EXPERTS]
    return table.agg(F.avg(F.least(*scores)).alias("oracle"), F.avg(sum(scores, F.lit(0.0)) / len(scores)).alias("overall"), *[F.avg(c).alias(f"{e}_mean") for e, c in zip(EXPERTS, scores, strict=True)])
