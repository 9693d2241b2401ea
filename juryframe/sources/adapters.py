"""Expert tables from the driver's tables, which hold no speech: each adapter is fixed and expressible in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juryframe.functions.choice import softmax
from juryframe.operators.segments import PART, segmented
from juryframe.operators.series import placed
from juryframe.operators.split import split
from juryframe.schema import EXPERTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle partitions for each part in which a table is read, some 8 MB of its file at Spark's default.
PARTS_OF_READ = 16


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` by ``key`` in as many partitions as its size asks for, where that is more than a shuffle has; else as it is.

    The number of a shuffle is fixed, so what a task groups, sorts and joins would grow with the table.
    """
    parts = PARTS_OF_READ * df.rdd.getNumPartitions()
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, hubert_wer, whisper_wer, w2v2_wer) from lineitem; keys that repeat take the least of each score."""
    key = F.expr("l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber")
    return (
        dealt(table(spark, sf_dir, "lineitem").withColumn("clip_id", key), "clip_id")
        .groupBy("clip_id")
        .agg(F.min(F.col("l_discount") * 10).alias("hubert_wer"), F.min(F.col("l_tax") * 10).alias("whisper_wer"), F.min(F.col("l_quantity") / 50).alias("w2v2_wer"))
    )


def split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(scores(spark, sf_dir), "clip_id")


def probs(spark: SparkSession, sf_dir: str, temperature: float = 0.5) -> DataFrame:
    """Scores with probs, a router's output: the softmax of the scores of the next expert in the round."""
    rotated = F.array(*[-F.col(f"{e}_wer") / F.lit(temperature) for e in (*EXPERTS[1:], EXPERTS[0])])
    return scores(spark, sf_dir).withColumn("probs", softmax(rotated))


def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, ref): the tokens of each turn of conversations."""
    words = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    return table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("clip_id"), words.alias("ref"))


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_text with a hypothesis for each expert: words dropped, doubled or reversed at fixed places.

    Clips are dealt out evenly first: what is done with two long texts takes far longer than moving one, and a file's clips are one task's.
    """
    ref, none = F.col("ref"), F.array().cast("array<string>")
    dropped = F.flatten(F.transform(ref, lambda x, i: F.when((i + 1) % 5 == 0, none).otherwise(F.array(x))))
    doubled = F.flatten(F.transform(ref, lambda x, i: F.when((i + 1) % 7 == 0, F.array(x, x)).otherwise(F.array(x))))
    reversed_ = F.transform(ref, lambda x, i: F.when((i + 1) % 4 == 0, F.reverse(x)).otherwise(x))
    dealt = clip_text(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "clip_id")
    return dealt.select("clip_id", "ref", dropped.alias("hubert"), doubled.alias("whisper"), reversed_.alias("w2v2"))


def expert_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, ref, expert, hyp) of hypotheses, a row for each expert."""
    rows = F.array(*[F.struct(F.lit(e).alias("expert"), F.col(e).alias("hyp")) for e in EXPERTS])
    return hypotheses(spark, sf_dir).select("clip_id", "ref", F.explode(rows).alias("r")).select("clip_id", "ref", "r.*")


def segments(spark: SparkSession, sf_dir: str, part_rows: int = PART) -> DataFrame:
    """(clip_id, part, start, frames): the embeddings of a label in order of their ids, in parts of ``part_rows``."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("clip_id"), "vec_id", "embedding")
    return segmented(rows, "clip_id", "vec_id", "embedding", part_rows)


#: Seconds of a range by which events are ordered.
STEP_SPAN = 86400.0


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, tag, step, value, place) of events: three runs, a tag for each kind of event; place is step - 1."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("run"), F.col("event_type").alias("tag"), "ts", "event_id", "value")
    return placed(rows, ["run", "tag"], ["ts", "event_id"], STEP_SPAN).select("run", "tag", (F.col("place") + 1).alias("step"), "value", "place")


#: What prices are divided by to make rates: a prime, so that no mean of them lies half-way between two rounded numbers.
PRICE_UNIT = 1009


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, wer) from part: a brand with its size as seed, the mean price as rate."""
    name = F.concat("p_brand", F.lit("-seed"), "p_size")
    return table(spark, sf_dir, "part").groupBy(name.alias("method")).agg((F.avg("p_retailprice") / PRICE_UNIT).alias("wer"))


def run_probs(spark: SparkSession, sf_dir: str, temperature: float = 0.5) -> DataFrame:
    """Split scores with run and probs: three routers, each with the softmax of the scores of another expert in the round."""
    scores_of = lambda k: [-F.col(f"{EXPERTS[(i + k) % len(EXPERTS)]}_wer") / F.lit(temperature) for i in range(len(EXPERTS))]
    runs = F.array(*[F.struct(F.lit(f"run{k}").alias("run"), softmax(F.array(*scores_of(k))).alias("probs")) for k in range(len(EXPERTS))])
    return split_scores(spark, sf_dir).withColumn("__run", F.explode(runs)).select("*", "__run.run", "__run.probs").drop("__run")


#: First dimension and width of each expert's frames in an embedding.
EXPERT_DIMS = {"hubert": (0, 32), "whisper": (16, 48), "w2v2": (0, 64)}


def expert_segments(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Sequences in parts for each expert, whose frames are some of the dimensions of an embedding."""
    parts = segments(spark, sf_dir)
    own = lambda at, n: F.transform("frames", lambda f: F.slice(f, at + 1, n))
    return {e: parts.withColumn("frames", own(*dims)) for e, dims in EXPERT_DIMS.items()}
