"""The trie of conversation prefixes, merged family by family.

Conversations whose ids share all but the last two digits are a family; its base is the conversation with the last two digits 0. A
conversation is rebuilt from the first turns of its base and its own later turns. Turns meet by base id, sorted by
conversation, and a task walks through one family after another: it rebuilds each conversation, turn by turn, and adds it to
the family's small trie. Only the combined nodes of families are shuffled, by the digest of their prefix, for the global trie.

What a node needs to know of its subtree is a sum over its members, so that nothing walks the global trie level by level. Every node
belongs to its smallest member, and what a conversation owns is the last part of its path. So a subtree's nodes are what its
members own of it: its childless nodes are the members that own one, and the code points of its different texts are what
members own from the node on. A second walk through the families adds up both, with each owner's share beside its turns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juryframe.llm.common import remove, written

#: Conversations in a family, and the number of turns that a base gives away at most, plus one.
FAMILY, GIVEN = 100, 6
#: A family's trie is handed on in parts of so many nodes, which the global merge puts together.
NODES = 1 << 16
ROOT = bytes(16)
_ROW = "base conv_id tag total before leaf digest chars".split()


def given(conv_id: int) -> int:
    """How many turns of its base a conversation begins with."""
    return zlib.crc32(str(conv_id).encode()) % GIVEN


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, 4096).columns], strict=True)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(base, conv_id, head, skipped, prefix, turns) of each conversation that has a head row, family by family.

    ``prefix`` are the turns of the base that it begins with, ``skipped`` its own turns that these replace, ``turns`` an iterator
    over prefix and later turns, each a digest and its code points. Only a handful of turns is held at a time.
    """
    at = {name: i for i, name in enumerate(_ROW)}
    for base, family in groupby(_rows(batches), lambda r: r[at["base"]]):
        first: list[tuple[bytes, int]] = []
        for conv_id, rows in groupby(family, lambda r: r[at["conv_id"]]):
            row = next(rows)
            head = row if row[at["tag"]] == 0 else None
            own = ((r[at["digest"]], r[at["chars"]]) for r in (rows if head else chain([row], rows)))
            start = list(islice(own, GIVEN - 1))
            if conv_id == base:
                first = start
            if head is not None:
                n = given(conv_id)
                yield base, conv_id, head, start[:n], first[:n], chain(first[:n], start[n:], own)


def _longs(keys: list[bytes]) -> list[pa.Array]:
    halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return [pa.array(halves[:, i].copy()) for i in range(2)]


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each family (kind 0) and the node where each conversation ends (kind 1)."""
    names = "kind k1 k2 p1 p2 depth chars path conv_id n_convs weight".split()

    def made(nodes: dict[bytes, list], ends: list[tuple[bytes, int]]) -> pa.RecordBatch:
        keys = [*nodes, *[k for k, _ in ends]]
        columns = list(zip(*nodes.values(), strict=True)) if nodes else [()] * 7
        parents = [p or ROOT for p in columns[0]] + [ROOT] * len(ends)
        orphan = np.array([p is None for p in columns[0]] + [True] * len(ends))
        longs = [pa.array([*c, *[None] * len(ends)], pa.int64()) for c in columns[1:]]
        longs[3] = pa.array([*columns[4], *[c for _, c in ends]], pa.int64())
        up = [pa.array(p.to_numpy(), mask=orphan) for p in _longs(parents)]
        kinds = pa.array([0] * len(nodes) + [1] * len(ends), pa.int32())
        return pa.RecordBatch.from_arrays([kinds, *_longs(keys), *up, *longs], names=names)

    nodes, ends, of = {}, [], None
    for base, conv_id, head, skipped, prefix, turns in _rebuilt(batches):
        if base != of and nodes:  # the family's trie is complete
            yield made(nodes, ends)
            nodes, ends = {}, []
        of = base
        total = head[3] + sum(c for _, c in prefix) - sum(c for _, c in skipped)
        key, parent, depth, chars, path = ROOT, None, 0, 0, 0
        for digest, size in chain([(None, 0)], turns):
            if digest is not None:
                key, parent, depth, chars = hashlib.md5(key + digest, usedforsecurity=False).digest(), key, depth + 1, size
            node = nodes.get(key)
            if node is None:
                if len(nodes) >= NODES:
                    yield made(nodes, ends)
                    nodes, ends = {}, []
                node = nodes[key] = [parent, depth, chars, path + chars, conv_id, 0, 0]
            node[4] = min(node[4], conv_id)
            node[5] += 1
            node[6] += total - path
            path += chars
        ends.append((key, conv_id))
    if nodes or ends:
        yield made(nodes, ends)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the owners of nodes add to every node on their paths: a childless node each, and the code points that they own from there on."""

    def made(sums: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*_longs(list(sums)), *[pa.array([s[i] for s in sums.values()], pa.int64()) for i in range(2)]], names=["k1", "k2", "n_leaves", "own_chars"])

    sums: dict[bytes, list[int]] = {}
    of = None
    for base, _, head, _, _, turns in _rebuilt(batches):
        if base != of and sums:
            yield made(sums)
            sums = {}
        of = base
        total, before, leaf = head[3:6]
        key, path = ROOT, 0
        for digest, size in chain([(None, 0)], turns):
            if digest is not None:
                key = hashlib.md5(key + digest, usedforsecurity=False).digest()
            if key not in sums and len(sums) >= NODES:
                yield made(sums)
                sums = {}
            mine = sums.setdefault(key, [0, 0])
            mine[0] += leaf
            mine[1] += total - max(path, before)
            path += size
    if sums:
        yield made(sums)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (k1, k2, conv_id), sorted: the SHA-256 of each node's ids; ids are read one after another, however many."""
    held, sha, done = None, None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(2)] + [pa.array([d[2] for d in done])], names=["k1", "k2", "ends_sha256"])

    for k1, k2, conv_id in _rows(batches):
        if held != (k1, k2):
            if held is not None:
                done.append((*held, sha.hexdigest()))
            if len(done) >= NODES:
                yield made()
                done = []
            held, sha = (k1, k2), hashlib.sha256(str(conv_id).encode())
        else:
            sha.update(b",%d" % conv_id)
    if held is not None:
        done.append((*held, sha.hexdigest()))
        yield made()


def _by_family(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """Turns and the head row (total, before, leaf) of conversations, each family in one task and in order of conversations."""
    none = [F.lit(None).cast("long").alias(c) for c in ("total", "before", "leaf")]
    rows = turns.select("base", "conv_id", F.lit(1).alias("tag"), *none, "digest", "chars", "turn")
    tops = heads.select("base", "conv_id", F.lit(0).alias("tag"), "total", "before", "leaf", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("chars"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"))
    return rows.union(tops).repartition("base").sortWithinPartitions("base", "conv_id", "tag", "turn", "digest").select(*_ROW)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Null roles and texts count as empty. Turns are ordered by ``turn``, null first; of equal ones by the digest of role
    and text, so repeated rows are turns of their own. A null conv_id names no conversation: its rows are left out. The base of a negative id is
    the next lower multiple of a hundred. An empty table has no conversations, hence no node. Other columns are not read, whatever
    their names. Texts of any length are digested where they are read, and a conversation of any length is walked turn by turn.
    """
    spark, scratch = conversations.sparkSession, []
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv_id = F.col("conv_id").cast("long")
    turns = conversations.filter("conv_id is not null").select(
        (conv_id - F.pmod(conv_id, F.lit(FAMILY))).alias("base"),
        conv_id.alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    turns = written(turns, scratch)
    totals = turns.groupBy("base", "conv_id").agg(F.sum("chars").alias("total")).withColumns({"before": F.lit(0).cast("long"), "leaf": F.lit(0).cast("long")})
    local = written(
        _by_family(turns, totals).mapInArrow(_tries, "kind int, k1 long, k2 long, p1 long, p2 long, depth long, chars long, path long, conv_id long, n_convs long, weight long"), scratch
    )
    same = [F.max(c).alias(c) for c in ("p1", "p2", "depth", "chars", "path")]
    nodes = written(local.filter("kind = 0").groupBy("k1", "k2").agg(*same, F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("weight").alias("weight")), scratch)
    children = nodes.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), scratch)
    owners = nodes.groupBy("conv_id").agg(F.max("path").alias("total"), F.min(F.col("path") - F.col("chars")).alias("before"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    owners = owners.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY)))
    shares = _by_family(turns, owners).mapInArrow(_shares, "k1 long, k2 long, n_leaves long, own_chars long")
    shares = shares.groupBy("k1", "k2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("own_chars").alias("own_chars"))
    ends = local.filter("kind = 1").select("k1", "k2", "conv_id").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    trie = nodes.join(shares, ["k1", "k2"]).join(ends, ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left")
    empty = F.sha2(F.lit(""), 256)
    out = written(
        trie.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("weight") - F.col("own_chars")).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256")
        )
    )
    for path in scratch:
        remove(spark, path)
    return out
