"""Connected components of a table of links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juryframe.llm.common import remove, shuffled, written


#: Links that a task contracts at once; there are as many tasks as the links need.
TASK_LINKS = 1 << 18


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (node, least node) of what a task's links connect, in place of these."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (above := up.get(x, x)) != x:
            up[x] = x = up.get(above, above)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = top(a), top(b)
            if p != q:
                up[max(p, q)] = min(p, q)
    nodes = list(up)
    for at in range(0, len(nodes), 1 << 16):
        some = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([top(x) for x in some], pa.int64())], names=["a", "b"])


def _large_star(links: DataFrame, scratch: list[str]) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), scratch)
    return both.filter("b > a").join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("root").alias("b"))


def _small_star(links: DataFrame, scratch: list[str]) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("root")), scratch)
    return down.join(shuffled(least), "a").filter("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b")).union(least.select("a", F.col("root").alias("b")))


def _are_stars(links: DataFrame) -> bool:
    """Whether no node of the different links (a, b), b < a, has two smaller neighbours or both a smaller and a larger one."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Links are first contracted in tasks of TASK_LINKS, which is all there is to do for a few of them. Then come
    alternating large-star and small-star rounds, until the links are stars: every node is linked to one smaller node, or smaller
    nodes are linked to it. Each round aggregates before it joins, so a node with very many
    links is reduced where they lie. The least neighbours are written before the join: its sides are then plain
    shuffles, which adaptive execution splits where a node has most of the links. Each round is written to the shared folder, which is cleared at the end. Null links and links of a node to itself are not used.
    """
    spark, scratch = links.sparkSession, []
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), scratch)
    tasks = max(1, math.ceil(links.count() / TASK_LINKS))
    dealt = links.coalesce(1) if tasks == 1 else links.repartition(tasks, "a", "b")
    links = written(dealt.mapInArrow(_contracted, "a long, b long").distinct() if tasks > 1 else dealt.mapInArrow(_contracted, "a long, b long"), scratch)
    for _ in range(max_rounds):
        if tasks == 1 or _are_stars(links):
            found = written(links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct()))
            for path in scratch:
                remove(spark, path)
            return found
        large = written(_large_star(links, scratch), scratch)
        links = written(_small_star(large, scratch).distinct(), scratch)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
