"""SimHash near-duplicates with pivot distance tables.

Candidates share bits: two differing bits touch at most two of six bands, so every linked pair agrees on four bands, and
pairs are looked for only among fingerprints that do. A table holds every candidate's Hamming distances to fixed
reference fingerprints (pivots). By the triangle inequality a pair at distance d differs by at most d in every coordinate,
so a pair whose largest difference is above the radius is discarded; survivors are verified bit by bit. (Distances to
pivots prune but make no key: those of unrelated fingerprints lie within a few bits of 32.)

Equal fingerprints are one row from the start. A group of more than ``GROUP`` fingerprints is not compared
pairwise but dealt again by five of seven parts of its two open bands; such a group has at most 2**7 members,
whatever the input, so no link is lost and no group grows without bound.

Where near-duplicates are asked for by the similarity of word shingles, fingerprints cannot find them all; ``near_groups`` adds the
candidates of ``near_text`` to those that it finds by fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juryframe.llm.common import cut, shuffled
from juryframe.llm.graph import components
from juryframe.llm.near_text import near_texts
from juryframe.llm.odd_sketch import Marks

BITS, BANDS, PARTS, RADIUS = 64, 6, 7, 2
#: The largest group that is compared pairwise.
GROUP = 256
_random = np.random.default_rng(64)
PIVOTS = _random.integers(0, 1 << 63, 24, dtype=np.uint64) * np.uint64(2)


def _split(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, parts)]


def _shared(parts: list[list[int]]) -> list[list[int]]:
    """The bits of all parts but two, for every choice of the two."""
    return [sorted(set().union(*parts) - set(parts[i]) - set(parts[j])) for i, j in combinations(range(len(parts)), 2)]


BLOCKS = _shared(_split(range(BITS), BANDS))
#: For each block: the finer blocks of a large group, which also share some of the bits that the block left open.
FINER = [[sorted({*block, *more}) for more in _shared(_split([b for b in range(BITS) if b not in block], PARTS))] for block in BLOCKS]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def coordinates(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot distance table: a row for each fingerprint, a column for each pivot."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def simhash(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.fromiter((digest(g, 42) for g in grams), dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text as a signed long; without words it is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[id_col], docs[text_col].cast("binary")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _deal(blocks_of, columns: list[str]):
    """Rows (block, key, fp) for every block of a fingerprint: the key is the block's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for block, mask, rows in blocks_of(batch):
                keys = (fps[rows].view(np.uint64) & np.uint64(mask)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block, np.int32)), pa.array(keys), pa.array(fps[rows])], names=columns)

    return run


def _coarse(batch: pa.RecordBatch):
    return ((i, _mask(bits), slice(None)) for i, bits in enumerate(BLOCKS))


def _finer(batch: pa.RecordBatch):
    block = batch.column("block").to_numpy(zero_copy_only=False)
    for i in np.unique(block):
        rows = np.flatnonzero(block == i)
        for j, bits in enumerate(FINER[i]):
            yield int(i) * 100 + j, _mask(bits), rows


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs, those that are enough to connect what they connect."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            above[p] = q
            out.append((x, y))
    return out


def _linked(fps: np.ndarray, run: np.ndarray) -> list[tuple[int, int]]:
    """Links among fingerprints of equal ``run``, all in sorted order: shifted comparisons, pruned by the pivot table."""
    out: list[tuple[int, int]] = []
    table = coordinates(fps, PIVOTS)
    at = np.arange(len(fps))
    for shift in range(1, len(fps)):
        at = at[: len(at) - (len(at) > 0 and at[-1] + shift >= len(fps))]
        at = at[run[at] == run[at + shift]]
        if not len(at):
            break
        far = np.abs(table[at] - table[at + shift]).max(axis=1)
        near = at[far <= RADIUS]
        near = near[np.bitwise_count(fps[near] ^ fps[near + shift]) <= RADIUS]
        if len(near):
            out += zip(fps[near].view(np.int64).tolist(), fps[near + shift].view(np.int64).tolist(), strict=True)
    if len(out) > 64:
        pairs = np.array(out, dtype=np.int64)
        out = _forest(pairs[:, 0], pairs[:, 1])
    return out


def _verify(limit: int | None):
    """Of rows sorted by (block, key): links (kind 0: a, b) and the members of groups over the limit (kind 1: fp, block)."""

    def work(block: np.ndarray, key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        fresh = np.r_[True, (block[1:] != block[:-1]) | (key[1:] != key[:-1])]
        run = np.cumsum(fresh) - 1
        sizes = np.bincount(run)
        size = sizes[run]
        small = (size > 1) & (size <= (limit or size.max()))
        links = _linked(fps[small].view(np.uint64), run[small]) if small.any() else []
        large = np.flatnonzero(size > limit) if limit else np.array([], np.int64)
        kind = [0] * len(links) + [1] * len(large)
        a = [x for x, _ in links] + fps[large].tolist()
        b = [y for _, y in links] + block[large].tolist()
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            # The last group may go on in the next batch.
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            if not last.all():
                yield work(*[x[~last] for x in held])
                held = [x[last] for x in held]
        if held is not None:
            yield work(*held)

    return run


def _grouped(dealt: DataFrame, limit: int | None) -> DataFrame:
    return dealt.repartition("block", "key").sortWithinPartitions("block", "key", "fp").mapInArrow(_verify(limit), "kind int, a long, b long")


def links(distinct: DataFrame, *, group: int = GROUP) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at two or fewer differing bits."""
    dealt = distinct.select("fp").mapInArrow(_deal(_coarse, ["block", "key", "fp"]), "block int, key long, fp long")
    found = cut(_grouped(dealt, group))
    large = found.filter("kind = 1").select(F.col("a").alias("fp"), F.col("b").cast("int").alias("block"))
    again = large.mapInArrow(_deal(_finer, ["block", "key", "fp"]), "block int, key long, fp long")
    return found.filter("kind = 0").union(_grouped(again, None)).select("a", "b")


def near_groups(docs: DataFrame, *, key_col: str, text_col: str = "text") -> DataFrame:
    """(key_col, root): near-duplicates by shingles of five words and a similarity of 0.8 or more.

    Candidates are texts whose fingerprints ``links`` connects, by bands and the pivot table, and those that ``near_text`` finds beyond
    the radius; each is verified on its shingles.

    Keys are unique and not null. Null and empty texts, and texts without words, are one group; repeated rows and ties have one root; an
    empty table stays empty; texts may be of any length, and other columns are not read, whatever their names.
    """
    return near_texts(docs, key_col=key_col, text_col=text_col, marks=Marks(partial(simhash, shingle=3), links))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, group: int = GROUP) -> DataFrame:
    """One row a document: doc_id, fp (signed long) and component_id, the smallest doc_id that links reach.

    Null and empty texts have fingerprint 0 and are linked like any other. Ids that repeat stay rows of their own;
    null ids are passed over for component_id, which is null only where all ids of a component are. An empty
    table stays empty. Texts may be of any length: a task holds one text's shingles as hashes of 8 bytes. Other columns are not
    read, whatever their names.
    """
    marked = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    near = components(links(distinct, group=group))
    roots = distinct.join(shuffled(near), distinct["fp"] == near["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(shuffled(roots.join(shuffled(ids), "root").select("fp", "component_id")), "fp").select("doc_id", "fp", "component_id")
