"""Near-duplicates by MinHash, with odd sketches between the bands and the exact check.

A text is the set of its different word shingles. Two texts are linked if the Jaccard similarity of their sets is at least a
``Rule``'s percent in a hundred. The MinHash samples of a set serve twice:

* A band is the hash of some samples; texts that agree on a band are candidates. With ``RULE``, a band agrees for a pair at the limit
  with probability 0.85 ** 7, and none of the 40 bands with probability 2e-7.
* All samples are folded into an odd sketch: each flips one bit of a bitmap, so the XOR of two bitmaps is the sketch of the
  samples in which they differ, and the number of its bits estimates the similarity, the more precisely the higher it is. A
  candidate is dropped if the XOR has more bits than a pair at the limit has, by six standard deviations.

What is left is verified on the full sets. Copies of one text are a single node from the start. Groups are compared as ``banding`` says:
members with the least node, then strays with the others in blocks, where a task compares sketches as bitmaps and texts are fetched
only for nodes that have a candidate. A pair is judged in the first band that it shares.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juryframe.llm import banding
from juryframe.llm.common import maybe_among, remove, shuffled, written
from juryframe.llm.graph import components


@dataclass(frozen=True)
class Rule:
    """Words in a shingle, the similarity in a hundred at which texts are linked, bands, and MinHash samples in a band."""

    shingle: int = 3
    percent: int = 85
    bands: int = 40
    values: int = 7

    @property
    def samples(self) -> int:
        return self.bands * self.values


RULE = Rule()


@dataclass(frozen=True)
class Marks:
    """Candidates beside those of the bands: a number for each text (``of``), and pairs (a, b) that link different numbers ``fp`` (``links``).

    Texts of one number are candidates too. All are verified like the others.
    """

    of: Callable[[bytes], int]
    links: Callable[[DataFrame], DataFrame]


#: Bytes of shingles that a task keeps of a block.
KEPT_BYTES = 64 << 20
#: Words of 64 bits in an odd sketch.
SKETCH = 16
SKETCH_BITS = 64 * SKETCH
_SKETCH_COLUMNS = [f"s{i}" for i in range(SKETCH)]
#: The most samples that a rule has.
_MOST = 512
_random = np.random.default_rng(85)
_FACTORS = _random.integers(0, 1 << 31, (_MOST, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WEIGHTS, _WORD_FACTORS = (_random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (_MOST, 64))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_PLACES = np.arange(_MOST, dtype=np.uint64) << np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    for m in _MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the different shingles; a shorter text is one shingle, and one without words has none."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.array([], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _WORD_FACTORS[k]
    return np.unique(_mixed(total))


def samples(grams: np.ndarray, n: int = RULE.samples) -> np.ndarray:
    """MinHash: the least value of the set under each of ``n`` hash functions."""
    high, factors = (grams >> np.uint64(32)).astype(np.uint32), _FACTORS[:n]
    least = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), 512):
        np.minimum(least, (factors * high[None, at : at + 512]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, bands: int = RULE.bands) -> np.ndarray:
    """A 64-bit key for each band, of the band's number and its samples."""
    rows = least.reshape(bands, -1).astype(np.uint64)
    mine = rows * _WEIGHTS[: rows.shape[1]]
    keys = _mixed(np.arange(1, bands + 1, dtype=np.uint64) * _MIX[0] + mine.sum(axis=1))
    return keys.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parity bitmap: a bit is 1 if an odd number of (place, sample) fall on it."""
    fallen = _mixed(_PLACES[: len(least)] + least.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(fallen.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def estimate(differing: int, n: int = RULE.samples) -> float:
    """The similarity of two sets by the number of bits in which sketches of ``n`` samples differ; 0 where these are half of all bits."""
    return max(0.0, 1 + SKETCH_BITS / (4 * n) * math.log(1 - 2 * differing / SKETCH_BITS)) if 2 * differing < SKETCH_BITS else 0.0


def most_differing(rule: Rule = RULE, deviations: float = 6.0) -> int:
    """How many bits of the sketches may differ at the rule's similarity: the mean and six standard deviations.

    The number of differing samples is binomial, and each flips two bits.
    """
    s, n = rule.percent / 100, rule.samples
    shrink = math.exp(-4 * n * (1 - s) / SKETCH_BITS)
    mean = SKETCH_BITS / 2 * (1 - shrink)
    spread = math.sqrt((2 * shrink) ** 2 * n * s * (1 - s) + mean * (1 - mean / SKETCH_BITS))
    return math.ceil(mean + deviations * spread)


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _signed(rule: Rule, marks: Marks | None):
    """(doc_id, digest) and text to (doc_id, digest, n, keys, sketch), and the mark, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, sketches = [], [], np.zeros((batch.num_rows, SKETCH), np.int64)
            for i, text in enumerate(batch.column(2)):
                grams = shingles(_bytes(text), rule.shingle)
                counts.append(len(grams))
                if len(grams):
                    least = samples(grams, rule.samples)
                    keys.append(band_keys(least, rule.bands))
                    sketches[i] = odd_sketch(least)
                else:
                    keys.append([])
            arrays = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            names = ["doc_id", "digest", "n", "keys", *_SKETCH_COLUMNS]
            arrays += [pa.array(sketches[:, i].copy()) for i in range(SKETCH)]
            if marks:
                arrays.append(pa.array(np.array([marks.of(_bytes(t)) for t in batch.column(2)], np.uint64).view(np.int64)))
                names.append("mark")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _verifier(rule: Rule):
    """Of (a, b, text_a, text_b) the pairs (a, b) whose full sets are similar. Pairs with the same b often follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grams = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i, node in enumerate(b):
                if node != held:
                    held, grams = node, shingles(_bytes(batch.column(3)[i]), rule.shingle)
                other = shingles(_bytes(batch.column(2)[i]), rule.shingle)
                shared = len(np.intersect1d(other, grams, assume_unique=True))
                if shared and 100 * shared >= rule.percent * (len(other) + len(grams) - shared):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in good], pa.int64()) for x in (a, b)], names=["a", "b"])

    return run


def _alike(rule: Rule) -> Column:
    """Whether sizes and sketches of x and y allow the similarity."""
    smaller, larger = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    differing = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _SKETCH_COLUMNS), F.lit(0))
    return (100 * smaller >= rule.percent * larger) & (differing <= most_differing(rule))


class _Block:
    """The two sides of a block as arrays, and the pairs across that sizes and sketches allow."""

    def __init__(self, block: pa.Table, rule: Rule) -> None:
        number = lambda c: block.column(c).to_numpy()
        stray = block.column("stray").to_numpy()
        self.x, self.y = np.flatnonzero(stray), np.flatnonzero(~stray)
        self.node, self.root, self.n = number("node"), number("root"), number("n")
        self.sketch = np.stack([number(c) for c in _SKETCH_COLUMNS], axis=1).view(np.uint64)
        self.percent, self.most = rule.percent, most_differing(rule)

    def candidates(self, x: int) -> np.ndarray:
        """Places of the other side that ``x`` may be linked with, the most alike first."""
        y = self.y
        fits = (self.root[y] != self.root[x]) & (100 * np.minimum(self.n[y], self.n[x]) >= self.percent * np.maximum(self.n[y], self.n[x]))
        y = y[fits]
        bits = np.bitwise_count(self.sketch[y] ^ self.sketch[x]).sum(axis=1)
        near = np.flatnonzero(bits <= self.most)
        return y[near[np.argsort(bits[near], kind="stable")]]


def _meeting(rule: Rule):
    """The rows of blocks that have a candidate on the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in banding.blocks(batches):
            block, met = _Block(table, rule), np.zeros(table.num_rows, bool)
            for x in block.x:
                found = block.candidates(x)
                met[found] = True
                met[x] = len(found) > 0
            if met.any():
                yield from table.select(["key", "i", "j", "stray", "node", "root"]).filter(pa.array(met)).to_batches()

    return run


class _Shingles:
    """The sets of a block's texts, each worked out when it is asked for and kept while there is room."""

    def __init__(self, texts: pa.ChunkedArray, shingle: int) -> None:
        self.texts, self.shingle, self.kept, self.size = texts, shingle, {}, 0

    def __getitem__(self, row: int) -> np.ndarray:
        if (found := self.kept.get(row)) is None:
            found = shingles(_bytes(self.texts[int(row)]), self.shingle)
            if self.size + found.nbytes > KEPT_BYTES:
                self.kept, self.size = {}, 0
            self.kept[row] = found
            self.size += found.nbytes
        return found


def _across(rule: Rule):
    """Links (a, b) of blocks that join different components, verified on the full sets."""

    def linked(grams: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Which of the other sets are similar; no set is empty."""
        sizes = np.array([len(o) for o in others])
        flat = np.concatenate(others)
        at = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
        shared = np.add.reduceat(grams[at] == flat, np.cumsum([0, *sizes[:-1]]), dtype=np.int64)
        return 100 * shared >= rule.percent * (len(grams) + sizes - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in banding.blocks(batches):
            block, sets = _Block(table, rule), _Shingles(table.column("text"), rule.shingle)
            forest, key = banding.Forest(block.node, block.root), table.column("key")[0].as_py()
            keys = np.array(table.column("keys").combine_chunks().flatten()).reshape(-1, rule.bands)
            for x in block.x:
                found = block.candidates(x)
                if len(found):  # a pair is judged in the first band that it shares
                    found = found[keys[x][(keys[found] == keys[x]).argmax(axis=1)] == key]
                for at in range(0, len(found), 64):
                    left = forest.apart(x, found[at : at + 64])
                    if len(left):
                        forest.link(x, left[linked(sets[x], [sets[y] for y in left])])
            yield forest.batch()

    return run


def _fetched(nodes: DataFrame, classes: DataFrame, texts: DataFrame, scratch: list[str]) -> DataFrame:
    """(node, text) of the different ``nodes``; only rows that may be among them are shuffled."""
    known = written(classes.select("node", "digest", "least").join(shuffled(nodes), "node"), scratch)
    place = F.xxhash64("digest", "doc_id")
    near = maybe_among(texts, place, known.select(F.xxhash64("digest", "least").alias("h")), "__maybe").filter("__maybe").drop("__maybe").alias("t")
    own = near.join(shuffled(known.alias("n")), (F.col("t.digest") == F.col("n.digest")) & F.col("t.doc_id").eqNullSafe(F.col("n.least"))).select("node", "text")
    return written(own.dropDuplicates(["node"]), scratch)


def _marked_pairs(classes: DataFrame, marks: Marks, scratch: list[str]) -> DataFrame:
    """Candidates (a, b) by their marks: the least nodes of linked marks, and each other node of a mark with its least one."""
    worded = classes.filter("n > 0").select("node", "mark")
    firsts = written(worded.groupBy("mark").agg(F.min("node").alias("first")), scratch)
    first = lambda c: shuffled(firsts.select(F.col("mark").alias(c), F.col("first").alias(f"first_{c}")))
    linked = marks.links(firsts.select(F.col("mark").alias("fp"))).join(first("a"), "a").join(first("b"), "b")
    own = worded.join(shuffled(firsts), "mark").filter("node <> first")
    return linked.select(F.greatest("first_a", "first_b").alias("a"), F.least("first_a", "first_b").alias("b")).union(own.select("node", "first"))


def _star_links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, rule: Rule, scratch: list[str]) -> DataFrame:
    """Those of the different ``pairs`` (a, b) that the sketches allow and that are links on the full sets."""
    sketched = classes.select("node", "n", *_SKETCH_COLUMNS)
    close = pairs.join(shuffled(sketched.alias("x")), F.col("a") == F.col("x.node")).join(shuffled(sketched.alias("y")), F.col("b") == F.col("y.node")).filter(_alike(rule))
    near = written(close.select("a", "b"), scratch)
    own = _fetched(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, texts, scratch)
    first, second = (own.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return written(near.join(shuffled(first), "a").join(shuffled(second), "b").select("a", "b", "text_a", "text_b").mapInArrow(_verifier(rule), "a long, b long"), scratch)


def _stray_links(grouped: DataFrame, near: DataFrame, classes: DataFrame, texts: DataFrame, rule: Rule, scratch: list[str]) -> DataFrame:
    """Links (a, b) between the components within groups."""
    rows = banding.strays(grouped, near, scratch).join(shuffled(classes.select("node", "n", *_SKETCH_COLUMNS)), "node")
    met = written(banding.in_blocks(rows).mapInArrow(_meeting(rule), banding.BLOCK), scratch)
    fetched = _fetched(met.select("node").distinct(), classes, texts, scratch)
    full = met.join(shuffled(classes.select("node", "n", "keys", *_SKETCH_COLUMNS)), "node").join(shuffled(fetched), "node")
    return written(banding.in_blocks(full).mapInArrow(_across(rule), "a long, b long"), scratch)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, text): texts as bytes; a null one has the digest of an empty one."""
    digest = F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary")))
    return docs.select(docs[id_col].alias("doc_id"), digest.alias("digest"), docs[text_col].cast("binary").alias("text"))


def roots_of(texts: DataFrame, rule: Rule, scratch: list[str], marks: Marks | None = None) -> DataFrame:
    """(digest, least, n, root) of every different text of ``texts``: its least id, the size of its set, and one root for all that links reach.

    Texts without words have no links, and each is its own root. ``marks`` adds candidates to those of the bands.
    """
    own = ["mark"] if marks else []
    kind = texts.schema["doc_id"].dataType.simpleString()
    signed = texts.mapInArrow(_signed(rule, marks), f"doc_id {kind}, digest binary, n long, keys array<long>, {', '.join(f'{c} long' for c in [*_SKETCH_COLUMNS, *own])}")
    one = signed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first(F.struct("n", "keys", *_SKETCH_COLUMNS, *own)).alias("m"))
    classes = written(one.select("digest", "least", "m.*").withColumn("node", F.monotonically_increasing_id()), scratch)
    grouped = banding.members(classes.select("node", "keys"), scratch)
    pairs = banding.stars(grouped)
    if marks:
        pairs = pairs.union(_marked_pairs(classes, marks, scratch)).distinct()
    near = components(_star_links(pairs, classes, texts, rule, scratch))
    near = banding.joined(near, _stray_links(grouped, near, classes, texts, rule, scratch))
    roots = near.select(F.col("node").alias("__node"), "root")
    return classes.select("digest", "node", "least", "n").join(shuffled(roots), F.col("node") == F.col("__node"), "left").select("digest", "least", "n", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """One row a document: doc_id, n_shingles (size of its set), component_id (smallest doc_id that links reach) and kept.

    ``kept`` is true where the document's id is the component's. Null and empty texts, and texts without words, have no shingles and
    are linked with nothing. Rows with one id stay rows of their own, each with its own text's component. Null ids are passed
    over for component_id, which is null only where all ids of a component are; such rows are kept. An empty table stays empty.
    ``docs`` is read four times. Other columns are not read, whatever their names. Texts may be of any length: a task holds
    the texts of one batch, or of one block and KEPT_BYTES of shingles.
    """
    scratch: list[str] = []
    texts = texts_of(docs, id_col, text_col)
    rooted = written(roots_of(texts, rule, scratch), scratch)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(rooted.join(shuffled(least), "root").select(F.col("digest").alias("d"), "n", "component_id"))
    for path in scratch:
        remove(docs.sparkSession, path)
    own = texts.select("doc_id", "digest").join(shuffled(found), F.col("digest") == F.col("d"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
