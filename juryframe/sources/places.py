"""Folders through Hadoop's file systems: the one that a cluster shares, what is free, and moving a finished copy into place."""

from __future__ import annotations

import tempfile

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """(file system, path) of a path or URI."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Where it is unset, a temporary folder if they are one process."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="juryframe-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def scheme(spark: SparkSession, path: str) -> str:
    fs, _ = place(spark, path)
    return fs.getUri().getScheme()


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = place(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = place(spark, path)
    fs.delete(at, True)


def modified(spark: SparkSession, path: str) -> int:
    """Milliseconds of the last change; 0 for a path that is not there."""
    fs, at = place(spark, path)
    return fs.getFileStatus(at).getModificationTime() if fs.exists(at) else 0


def free_bytes(spark: SparkSession, path: str) -> int:
    """What is left where ``path`` lies; its folder need not be there yet."""
    fs, at = place(spark, path)
    while not fs.exists(at) and at.getParent() is not None:
        at = at.getParent()
    return fs.getStatus(at).getRemaining()


def put_in_place(spark: SparkSession, made: str, target: str) -> None:
    """Renames a finished folder; what stood there goes first, so a reader finds a whole copy or none."""
    fs, at = place(spark, target)
    fs.delete(at, True)
    fs.mkdirs(at.getParent())
    if not fs.rename(place(spark, made)[1], at):
        raise OSError(f"could not rename {made} to {target}")
