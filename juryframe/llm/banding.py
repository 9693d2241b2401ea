"""Groups of nodes that share a band key, compared so that no group is gathered and no pairs are handed on but links.

Every node has a list of keys, one for each band; nodes that share a key form a group. Each member is first compared with its group's
least node (``stars``). Where the links found leave a group in several components, its strays, which lie outside the component of the
least node, are compared with the others in blocks of at most ``CHUNK`` by ``CHUNK`` nodes (``strays``): a large group is many
blocks. Within a block a ``Forest`` spares pairs that are connected, so a block hands on fewer links than it has nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juryframe.llm.common import shuffled, written
from juryframe.llm.graph import components

#: Nodes on a side of a block.
CHUNK = 1024
BLOCK = "key long, i long, j long, stray boolean, node long, root long"


def members(nodes: DataFrame, scratch: list[str]) -> DataFrame:
    """(key, node, lead) of the groups of two or more among ``nodes`` (node, keys); lead is the least node."""
    dealt = nodes.select(F.explode("keys").alias("key"), "node")
    groups = dealt.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    return written(dealt.join(shuffled(groups), "key"), scratch)


def stars(grouped: DataFrame) -> DataFrame:
    """The different pairs (a, b) of a member and the least node of its group."""
    return grouped.filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()


def strays(grouped: DataFrame, near: DataFrame, scratch: list[str]) -> DataFrame:
    """(key, i, j, stray, node, root): blocks of the groups that lie in more than one component of ``near``.

    A block holds strays (stray true) and others, but for the least node, with which all were compared. Each stray meets each other node of
    its group in one block.
    """
    roots = near.select(F.col("node").alias("__node"), "root")
    rooted = written(grouped.join(shuffled(roots), F.col("node") == F.col("__node"), "left").select("key", "node", "lead", F.coalesce("root", "node").alias("root")), scratch)
    # Home is the component of the least node.
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.when(F.col("node") == F.col("lead"), F.col("root"))).alias("home")).filter("low <> high")
    apart = written(rooted.join(shuffled(split.select("key", "home")), "key").withColumn("stray", F.col("root") != F.col("home")), scratch)
    chunks = lambda condition: F.ceil(F.count_if(condition) / CHUNK)
    sizes = apart.groupBy("key").agg(chunks(F.col("stray")).alias("ni"), chunks(F.col("node") != F.col("lead")).alias("nj"))
    apart = apart.join(shuffled(sizes), "key")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    first = apart.filter("stray").select("key", own("ni").alias("i"), each("nj").alias("j"), F.lit(True).alias("stray"), "node", "root")
    return first.union(apart.filter("node <> lead").select("key", each("ni").alias("i"), own("nj").alias("j"), F.lit(False).alias("stray"), "node", "root"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with the rows of each block one after another in one task."""
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, which follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
        for at, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            part = batch.slice(int(at), int(end - at))
            if held and any(held[0].column(c)[0] != part.column(c)[0] for c in ("key", "i", "j")):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Components of a block's roots, as links join them, and the links that did."""

    def __init__(self, node: np.ndarray, root: np.ndarray) -> None:
        self.node, self.root, self.links = node, root, []
        self._up: dict[int, int] = {}

    def top(self, row: int) -> int:
        r, up = int(self.root[row]), self._up
        while (above := up.get(r, r)) != r:
            up[r] = r = up.get(above, above)
        return r

    def apart(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Those of ``ys`` that are not connected with ``x``."""
        mine = self.top(x)
        return np.array([y for y in ys.tolist() if self.top(y) != mine], np.int64)

    def link(self, x: int, ys: np.ndarray) -> None:
        for y in ys.tolist():
            if (p := self.top(y)) != (q := self.top(x)):
                self._up[p] = q
                self.links.append((int(self.node[x]), int(self.node[y])))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in self.links], pa.int64()) for i in range(2)], names=["a", "b"])


def joined(near: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components that ``near`` has and ``links`` join; those of before stand as links to their roots."""
    return near if links.isEmpty() else components(near.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))
