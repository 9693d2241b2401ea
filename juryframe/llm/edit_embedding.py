"""Document fingerprints by randomised edit embedding.

A walk moves over a text's characters. At step j it writes the character it stands on, and then a random bit, shared by
all texts and chosen by (j, character), says whether it moves on. Two texts at a small edit distance are written as
sequences at a small Hamming distance: after an edit the two walks fall into step again. A fingerprint samples the
written sequence at fixed steps, the same for all texts of about one length, as four bits of a hash of the characters
there. So the likeness of two fingerprints, the share of samples that agree less what chance makes agree, falls with the
edit distance of the texts.

Texts of up to 2**k characters take the samples of scales k and k + 1, so that texts whose lengths differ by less than
a factor of two have a scale in common.

Fingerprints that are alike are found by bands: a band is some samples drawn from the first L of a scale, and a
fingerprint has bands for the largest L of a grid that its text fills and for the one before, so two texts of about one length
have bands in common. Fingerprints that agree on a band are verified (see ``banding``); those that links connect are a class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juryframe.llm import banding
from juryframe.llm.common import cut, maybe_among, remove, shuffled, written
from juryframe.llm.graph import components

CLASSES, PERIOD, SAMPLES, LEAST_SCALE = 64, 4096, 128, 4
PAD, CHANCE = 16, 1 / 16
DIGITS = np.frombuffer(b"0123456789abcdef-", np.uint8)
#: Characters walked over at once; bounds a task's memory.
CHUNK = 8_000_000
#: Below this many texts a walk is made text by text.
FEW = 24
#: Fingerprints of this likeness or more are linked; a pair at it shares a band with this probability at least.
ALIKE, RECALL = 0.8, 0.93
#: Numbers of samples from whose first ones bands are drawn.
GRID = np.array([2, 3, 4, 6, 8, 11, 16, 23, 32, 45, 64, 90, 128])
#: A text that fills this share of its scale can be like one that is beyond it.
NEAR_FULL = 0.75


def _advance() -> np.ndarray:
    """For (step, class): the number of steps until the walk has left the character it stands on."""
    bits = np.random.default_rng(7).integers(0, 2, (PERIOD, CLASSES), dtype=np.int8)
    bits[0] = 1
    steps, now = np.zeros((PERIOD, CLASSES), np.int32), np.zeros(CLASSES, np.int32)
    for j in [*range(PERIOD - 1, -1, -1)] * 2:
        now = np.where(bits[j] == 1, 1, now + 1)
        steps[j] = now
    return steps.ravel()


ADVANCE = _advance()
_ADVANCE_LIST = ADVANCE.tolist()


def sample_steps(scale: int) -> np.ndarray:
    """The sampled steps of a scale: texts of up to 2**scale characters take about twice as many steps."""
    return np.sort(np.random.default_rng(1000 + scale).integers(0, 2 << scale, SAMPLES))


def classes_of(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(2654435761)) >> np.uint32(20)).astype(np.uint8) & np.uint8(CLASSES - 1)


def walk(classes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks over slices of ``classes``, all texts side by side, each from its own start step.

    Returns the step at which each character is first stood on (slices one after another), where each slice's steps
    begin in it, and the step after each slice's last character.
    """
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    steps = np.empty(int(lengths.sum()), np.int32)
    order = np.argsort(-lengths, kind="stable")
    n, at, out, j = lengths[order], offsets[order].copy(), begin[order].copy(), starts[order].astype(np.int32)
    t, active = 0, int((n > 0).sum())
    while active >= FEW:
        # All of these have more than t characters.
        stop = int(n[active - 1])
        for _ in range(stop - t):
            steps[out[:active]] = j[:active]
            j[:active] += ADVANCE[((j[:active] & (PERIOD - 1)) << 6) | classes[at[:active]]]
            at[:active] += 1
            out[:active] += 1
        t = stop
        active = int(np.searchsorted(-n, -t, side="left"))
    for i in range(active):
        k, written = int(j[i]), []
        for c in classes[at[i] : at[i] + n[i] - t].tolist():
            written.append(k)
            k += _ADVANCE_LIST[(k & (PERIOD - 1)) << 6 | c]
        steps[out[i] : out[i] + len(written)] = written
        j[i] = k
    ends = np.empty(len(lengths), np.int64)
    ends[order] = j
    return steps, begin, ends


def symbols(codes: np.ndarray, steps: np.ndarray, end: int) -> tuple[int, np.ndarray]:
    """(scale, samples): at each sampled step four bits of a hash of the three characters there, or PAD past the end."""
    n = len(codes)
    scale = max(LEAST_SCALE, (n - 1).bit_length() if n else 0)
    asked = np.concatenate((sample_steps_of(scale), sample_steps_of(scale + 1)))
    out = np.full(len(asked), PAD, np.uint8)
    live = asked < end
    if n and live.any():
        i = np.searchsorted(steps, asked[live], side="right") - 1
        h = codes[i].astype(np.uint64)
        for k in (1, 2):
            h = h * np.uint64(0x100000001B3) + np.where(i + k < n, codes[np.minimum(i + k, n - 1)], 0).astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[live] = (h >> np.uint64(60)).astype(np.uint8)
    return scale, out


_STEPS: dict[int, np.ndarray] = {}


def sample_steps_of(scale: int) -> np.ndarray:
    if scale not in _STEPS:
        _STEPS[scale] = sample_steps(scale)
    return _STEPS[scale]


def spelled(scale: int, samples: np.ndarray) -> str:
    """The fingerprint as text: two hex digits of scale, then a digit for each sample of both scales."""
    return f"{scale:02x}" + DIGITS[samples].tobytes().decode()


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1: the share of samples of the common scale that agree, less chance; 0 without a common scale."""
    scale = max(a[0], b[0])
    if min(a[0], b[0]) < scale - 1:
        return 0.0
    x, y = (p[1][SAMPLES * (scale - p[0]) :][:SAMPLES] for p in (a, b))
    either = (x != PAD) | (y != PAD)
    if not either.any():
        return 1.0
    same = float(((x == y) & either).sum()) / float(either.sum())
    return max(0.0, (same - CHANCE) / (1 - CHANCE))


def parsed(fingerprint: str) -> tuple[int, np.ndarray]:
    digits = np.frombuffer(fingerprint[2:].encode(), np.uint8)
    return int(fingerprint[:2], 16), _VALUES[digits]


_VALUES = np.zeros(128, np.uint8)
_VALUES[DIGITS] = np.arange(len(DIGITS), dtype=np.uint8)


class Pairs:
    """Fingerprints of texts, and of each text with its last half replaced by the head of another."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.n = np.array([len(t) for t in texts], np.int64)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.classes = classes_of(self.codes)
        self.at = np.concatenate(([0], np.cumsum(self.n)[:-1])).astype(np.int64)
        self.steps, _, self.ends = walk(self.classes, self.at, self.n, np.zeros(len(texts), np.int64))
        self.own = [symbols(self.codes[o : o + n], self.steps[o : o + n], e) for o, n, e in zip(self.at, self.n, self.ends, strict=True)]

    def edited(self, rows: np.ndarray, following: np.ndarray) -> Iterator[tuple[str, tuple[int, np.ndarray]]]:
        """For each of ``rows``: the sha256 and the samples of its edited text; ``following`` gives the other texts' rows."""
        n = self.n[rows]
        tail = np.minimum(n // 2, self.n[following])
        head = n - n // 2
        starts = np.array([self.steps[self.at[r] + h] if h < m else self.ends[r] for r, h, m in zip(rows, head, n, strict=True)], np.int64)
        steps, begin, ends = walk(self.classes, self.at[following], tail, starts)
        for i, (r, f) in enumerate(zip(rows, following, strict=True)):
            h, m, o, p = int(head[i]), int(tail[i]), int(self.at[r]), int(self.at[f])
            text = self.texts[r][:h] + self.texts[f][:m]
            codes = np.concatenate((self.codes[o : o + h], self.codes[p : p + m]))
            walked = np.concatenate((self.steps[o : o + h], steps[begin[i] : begin[i] + m]))
            yield hashlib.sha256(text.encode()).hexdigest(), symbols(codes, walked, int(ends[i]) if m else int(starts[i]))


def _rows(ids: list, texts: list[str], rows: list[int], following: list[int]) -> dict[str, list]:
    """Result columns for ``rows`` of ``texts``."""
    pairs, out = Pairs(texts), {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    for r, f, (sha, other) in zip(rows, following, pairs.edited(np.array(rows, np.int64), np.array(following, np.int64)), strict=True):
        mine = pairs.own[r]
        for k, v in zip(out, (ids[r], len(texts[r]), sha, spelled(*mine), spelled(*other), likeness(mine, other), likeness(mine, pairs.own[f])), strict=True):
            out[k].append(v)
    return out


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are shuffled compressed; a null one is empty."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [compress(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc_id", "h", "text"])


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a partition in ascending order: a result row for each document but the first, whose neighbour lies elsewhere.

    The first and last document come out as rows of kind 1 and 2 with their texts.
    """
    import zstandard

    part, held = TaskContext.get().partitionId(), None

    def batch_of(kind: int, n: int, cols: dict[str, list] | None, doc=None, text=None) -> pa.RecordBatch:
        cols = cols or {k.split()[0]: [None] * n for k in RESULT.split(", ")} | {"doc_id": [doc]}
        arrays = [pa.array(c, t) for c, t in zip(cols.values(), _TYPES, strict=True)]
        more = [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([text] * n, pa.string())]
        return pa.RecordBatch.from_arrays([*arrays, *more], names=[*cols, "kind", "part", "text"])

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [zstandard.decompress(t).decode() for t in batch.column(1).to_pylist()]
        for start, stop in _chunks(texts):
            some, its = texts[start:stop], ids[start:stop]
            if held is None:
                yield batch_of(1, 1, None, its[0], some[0])
            else:
                some, its = [held[1], *some], [held[0], *its]
            held = (its[-1], some[-1])
            if len(some) > 1:
                yield batch_of(0, len(some) - 1, _rows(its, some, [*range(1, len(some))], [*range(len(some) - 1)]))
    if held is not None:
        yield batch_of(2, 1, None, *held)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows for (row, doc_id, text, following text)."""
    for batch in batches:
        for row, doc, text, other in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            cols = _rows([doc, None], [text, other], [0], [1])
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols.values(), _TYPES, strict=True)], pa.array([row], pa.int64())], names=[*cols, "row"])


def edit_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alike: float = ALIKE) -> DataFrame:
    """One row a document: its fingerprint, that of its edited text, its likeness to it and to the next document, and its class.

    The next document is the one before it in ascending order of id (null first), texts' hashes and texts; the smallest
    one's is the largest. Null texts are empty texts. Rows that repeat are each other's neighbours; a document alone in
    its table is its own; an empty table stays empty. Texts move once, to be in order; only the two at the ends of each task's
    range move again. A task holds some texts at a time, of any length. Ids are cast to long, and a text that is no number
    raises. Other columns are not read, whatever their names.

    class_id is the smallest id that links of likeness ``alike`` reach (null ids are passed over, and a class without others has
    null), class_size the number of its rows.
    """
    names = [x.split()[0] for x in RESULT.split(", ")]
    ordered = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].cast("binary").alias("text"))
    ordered = ordered.mapInArrow(_packed, "doc_id long, h long, text binary")
    ordered = ordered.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    done = written(ordered.mapInArrow(_along, RESULT + ", kind int, part int, text string").withColumn("row", F.monotonically_increasing_id()))
    # One number for each range that has rows.
    parts = sorted(r["part"] for r in done.filter("kind = 2").select("part").collect())
    results = done.filter("kind = 0").select(*names, "row")
    if parts:
        before = docs.sparkSession.createDataFrame(list(zip(parts, parts[-1:] + parts[:-1], strict=True)), "part int, source int")
        firsts = done.filter("kind = 1").select("part", "row", "doc_id", "text")
        lasts = done.filter("kind = 2").select(F.col("part").alias("source"), F.col("text").alias("other"))
        ends = firsts.join(before, "part").join(lasts, "source").select("row", "doc_id", "text", "other").mapInArrow(_alone, RESULT + ", row long")
        results = results.union(written(ends))
    return with_classes(results, alike).select(*names, "class_id", "class_size")


def band_shape(n: int, alike: float, recall: float = RECALL) -> tuple[int, int]:
    """(samples in a band, bands): unrelated ones among ``n`` fingerprints rarely agree on a band, like ones mostly on one at least."""
    width = max(4, math.ceil(math.log2(max(n, 2)) / 4) + 1)
    agree = (alike * (1 - CHANCE) + CHANCE) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def band_keys(scales: np.ndarray, samples: np.ndarray, width: int, bands: int) -> list[np.ndarray]:
    """The keys of each fingerprint's bands; ``samples`` has a row of two scales for each."""
    out: list[list[np.ndarray]] = [[] for _ in scales]
    for half in (0, 1):
        mine = samples[:, SAMPLES * half : SAMPLES * (half + 1)]
        filled = (mine != PAD).sum(axis=1)
        level = np.searchsorted(GRID, filled, side="right") - 1
        for down in (0, 1) if not half else (0,):
            at = level - down
            use = (at >= 0) & ((half == 0) | (filled >= NEAR_FULL * SAMPLES / 2))
            for k in np.unique(at[use]).tolist():
                rows = np.flatnonzero(use & (at == k))
                places = np.random.default_rng([k, width]).integers(0, GRID[k], (bands, width))
                keys = (scales[rows, None].astype(np.uint64) + np.uint64(half)) * np.uint64(1 << 20) + np.uint64(k << 12) + np.arange(bands, dtype=np.uint64)[None, :]
                for column in places.T:
                    keys = (keys ^ mine[rows][:, column].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    keys ^= keys >> np.uint64(29)
                for r, own in zip(rows.tolist(), keys.view(np.int64), strict=True):
                    out[r].append(own)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _stacked(fingerprints: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(scales, samples) of fingerprints, a row each."""
    chars = np.frombuffer("".join(fingerprints.to_pylist()).encode(), np.uint8).reshape(-1, 2 + 2 * SAMPLES)
    return _VALUES[chars[:, 0]].astype(np.int64) * 16 + _VALUES[chars[:, 1]], _VALUES[chars[:, 2:]]


def likenesses(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``likeness`` of many pairs."""
    scale, place = np.maximum(a[0], b[0]), np.arange(SAMPLES)
    one = lambda p: np.take_along_axis(p[1], (SAMPLES * np.clip(scale - p[0], 0, 1))[:, None] + place, axis=1)
    x, y = one(a), one(b)
    either = ((x != PAD) | (y != PAD)).sum(axis=1)
    same = ((x == y) & (x != PAD)).sum(axis=1) / np.maximum(either, 1)
    found = np.where(either > 0, np.maximum(0.0, (same - CHANCE) / (1 - CHANCE)), 1.0)
    return np.where(np.minimum(a[0], b[0]) < scale - 1, 0.0, found)


def with_classes(results: DataFrame, alike: float) -> DataFrame:
    """``results`` (row, doc_id, fingerprint and others), each row once, with class_id and class_size.

    Only rows whose fingerprint is another row's as well, or linked, move; see ``maybe_among``.
    """
    signed = results.select("row", "doc_id", "fingerprint", F.unhex(F.md5("fingerprint")).alias("digest"))
    counted = signed.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    counted = cut(counted)
    width, bands = band_shape(counted.count(), alike)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            keys = band_keys(*_stacked(batch.column(1)), width, bands)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            good = pa.array(likenesses(_stacked(batch.column(2)), _stacked(batch.column(3))) >= alike)
            yield batch.filter(good).select([0, 1])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in banding.blocks(batches):
            scales, samples = _stacked(block.column("payload").combine_chunks())
            stray, root = block.column("stray").to_numpy(), block.column("root").to_numpy()
            forest, others = banding.Forest(block.column("node").to_numpy(), root), np.flatnonzero(~stray)
            for x in np.flatnonzero(stray):
                left = forest.apart(x, others)
                mine = (np.full(len(left), scales[x]), np.broadcast_to(samples[x], (len(left), samples.shape[1])))
                forest.link(x, left[likenesses(mine, (scales[left], samples[left])) >= alike])
            yield forest.batch()

    # Equal fingerprints have equal keys, so the keys of any row of a class stand for it.
    scratch: list[str] = []
    nodes = signed.select("row", "fingerprint").mapInArrow(keyed, "node long, keys array<long>").join(counted.select("node").hint("shuffle_hash"), "node", "left_semi")
    grouped = banding.members(nodes, scratch)
    known = written(grouped.select("node").distinct(), scratch)
    payloads = results.select(F.col("row").alias("node"), F.col("fingerprint").alias("payload"))
    payloads = maybe_among(payloads, F.col("node"), known.select(F.col("node").alias("h")), "__maybe").filter("__maybe").select("node", "payload")
    payloads = written(payloads.join(known.hint("shuffle_hash"), "node", "left_semi"), scratch)
    first, second = (payloads.select(F.col("node").alias(c), F.col("payload").alias(f"payload_{c}")) for c in "ab")
    star = banding.stars(grouped).join(shuffled(first), "a").join(shuffled(second), "b").select("a", "b", "payload_a", "payload_b")
    near = components(written(star.mapInArrow(similar, "a long, b long"), scratch))
    rows = banding.in_blocks(banding.strays(grouped, near, scratch).join(shuffled(payloads), "node"))
    near = banding.joined(near, written(rows.mapInArrow(across, "a long, b long"), scratch)).withColumnRenamed("node", "__node")
    roots = cut(counted.join(shuffled(near), F.col("node") == F.col("__node"), "left").select("digest", "least", "n", F.coalesce("root", "node").alias("root")))
    for path in scratch:
        remove(results.sparkSession, path)
    sizes = roots.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size")).filter("class_size > 1")
    shared = cut(roots.join(shuffled(sizes), "root").select(F.col("digest").alias("__digest"), "class_id", "class_size"))
    marked = maybe_among(results.withColumn("__digest", F.unhex(F.md5("fingerprint"))), F.xxhash64("__digest"), shared.select(F.xxhash64("__digest").alias("h")), "__maybe")
    alone = marked.filter("not __maybe").withColumns({"class_id": F.col("doc_id"), "class_size": F.lit(1).cast("long")})
    rest = marked.filter("__maybe").join(shuffled(shared), "__digest", "left").withColumns({"class_id": F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")), "class_size": F.coalesce("class_size", F.lit(1))})
    columns = [*results.columns, "class_id", "class_size"]
    return alone.select(columns).union(rest.select(columns))
