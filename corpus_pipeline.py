"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns the columns of ``documents``,
but for the last, which returns pieces of sequences. Between stages the documents are written as Parquet to the folder
that the cluster shares. The stages that drop documents decide by row, so rows whose ids are null or repeat stand for
themselves. Further columns of any name stay. Empty tables pass through. ``run`` removes what it wrote between stages, also when a stage
fails; the folder of its result is the user's.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juryframe.llm import mixing, packing, quality_rules, secrets, simhash
from juryframe.llm.common import cut, maybe_among, remove, shared_dir, shuffled, table, unused

#: Folders of keyed rows that the stages of this run (this thread) have written; ``run`` removes them.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def _keyed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, written once, so that every reader finds the same keys; and the key's name."""
    (row,) = unused(docs.columns, "__row")
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    if (scratch := _SCRATCH.get()) is not None:
        scratch.append(path)
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path), row


def _without(keyed: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """``keyed`` but for ``rows``, given by their keys. Only rows that may be among these are shuffled."""
    gone, maybe = unused([*keyed.columns], "__gone", "__maybe")
    rows = cut(rows.select(F.col(row).alias(gone)))
    marked = maybe_among(keyed, F.col(row), rows.select(F.col(gone).alias("h")), maybe)
    rest = marked.filter(F.col(maybe)).join(rows.hint("shuffle_hash"), F.col(row) == F.col(gone), "left_anti")
    return marked.filter(~F.col(maybe)).select(keyed.columns).union(rest.select(keyed.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged for itself."""
    keyed, row = _keyed(spark, docs)
    judged = quality_rules.judge_documents(keyed, table(spark, sf_dir, "labels"), key_col=row)
    return _without(keyed, row, judged.filter("not kept")).select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with five-word similarity 0.8 or more, the row with the smallest id; null ids come last."""
    keyed, row = _keyed(spark, docs)
    near = cut(simhash.near_groups(keyed, key_col=row))
    groups = cut(near.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    near = near.join(shuffled(groups.select("root")), "root")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text", "lang", "source", "n_chars"), row)
    ordered = cut(keyed.select(row, order.alias("order")).join(shuffled(near), row).select("root", row, "order"))
    first = cut(ordered.groupBy("root").agg(F.min("order").alias("first")))
    return _without(keyed, row, ordered.join(shuffled(first), "root").filter(F.col("order") != F.col("first"))).select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars brought up to date where a text changed."""
    return secrets.redact_secrets(docs, chars_col="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    (name,) = unused([c[: len("mix_")] for c in docs.columns], "mix_")
    return mixing.take_copies(mixing.mix_documents(docs, prefix=name), docs.columns, prefix=name)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence of its own."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Several stages are beyond SQL; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``. Where a stage fails, what was written so far is removed."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    scratch: list[str] = []
    token = _SCRATCH.set(scratch)
    try:
        for k, (_, stage) in enumerate(STAGES):
            path = f"{folder}/{k}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            for done in [*scratch, *[f"{folder}/{k - 1}"] * (k > 0)]:
                remove(spark, done)
            scratch.clear()
    except BaseException:
        for left in [*scratch, folder]:
            remove(spark, left)
        raise
    finally:
        _SCRATCH.reset(token)
    return docs
