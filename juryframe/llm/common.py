"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as keep it apart from ``columns``, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Where that is unset, a temporary folder takes its place if driver and
    executors are one process, as in a local test; on a cluster each machine would have its own, so that is an error.
    """
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            known = tempfile.mkdtemp(prefix="juryframe-")
        spark.sparkContext.setCheckpointDir(known)
        known = spark.sparkContext.getCheckpointDir()
    return known


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, where lost executors cannot take it along.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes it when nothing refers to it any more.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """``df`` written once as a compressed table in the shared folder; the folder's path is added to ``scratch``, if given.

    Unlike a checkpoint, whose estimated size is that of the plan it came from, it is planned by the size of its files. So it
    is what rounds of joins are built of: their estimates would double in digits with each join.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(side: DataFrame) -> DataFrame:
    """One side of a join of two tables that grow with the input: it is joined by a shuffle.

    By itself Spark broadcasts a side whose file or estimate is below a limit, and a compressed file below it can hold many times as much, all of
    which would pass through the driver.
    """
    return side.hint("merge")


#: Bits of the filter of ``maybe_among``: at most 2048 rows of 4 KB, whatever the input.
FILTER_BITS, FILTER_BUCKET = 1 << 26, 1 << 15


def maybe_among(df: DataFrame, key: Column, known: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: true where the long ``key`` is one of ``known`` (h long), and by chance for some others.

    The filter is a bitmap of fixed size, so it can be broadcast; where keys are so many that it is full, all rows pass. It
    spares rows a shuffle, and what follows has to decide.
    """
    place = lambda h: F.pmod(F.xxhash64(h), F.lit(FILTER_BITS))
    at, bucket, bits = unused([*df.columns, name], "__at", "__bucket", "__bits")
    sums = known.select(place(F.col("h")).alias(at)).groupBy(F.floor(F.col(at) / FILTER_BUCKET).alias(bucket)).agg(F.bitmap_construct_agg(F.col(at) % FILTER_BUCKET).alias(bits))
    found = df.withColumn(at, place(key)).withColumn(bucket, F.floor(F.col(at) / FILTER_BUCKET)).join(F.broadcast(cut(sums)), bucket, "left")
    bit = F.col(at) % FILTER_BUCKET
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn(name, F.coalesce((F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2) == 1, F.lit(False))).drop(at, bucket, bits)


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
