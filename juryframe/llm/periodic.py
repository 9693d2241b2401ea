"""Periodic runs of words: stretches that repeat a block of words again and again, and texts without the repeats.

A run of period q has a Lyndon word of q words among its rotations, in the order of words or in the reversed order, and that
word is the longest Lyndon word which starts where it starts. So all runs are found from the longest Lyndon words at every place
under both orders. These come from one scan from right to left with a stack of next smaller suffixes. Suffixes
are compared, and candidates extended to both sides, by their longest common extension: a few words directly, then steps that
double and halve over rolling hashes. Every run is verified word by word, so a hash that collides makes no wrong run.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has at least so many words, and at least so many periods.
LEAST_LENGTH, LEAST_POWER = 24, 3
#: Words that a comparison looks at before it turns to hashes.
DIRECT = 8
#: Bytes of collapsed text in a batch that is handed back.
BATCH_BYTES = 8 << 20
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers = array("Q", [1])

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


class Words:
    """Numbers that stand for words, with common extensions of their suffixes and prefixes."""

    def __init__(self, ids: Sequence[int]) -> None:
        self.ids, self.n, self._sums = ids, len(ids), None

    def _hashes(self) -> tuple[array, array]:
        if self._sums is None:
            self._sums = array("Q", accumulate(self.ids, lambda h, x: (h * _BASE + x + 1) % _PRIME, initial=0))
            while len(_powers) <= self.n:
                _powers.append(_powers[-1] * _BASE % _PRIME)
        return self._sums, _powers

    def ahead(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on; i < j."""
        a, most = self.ids, self.n - j
        k, near = 0, min(most, DIRECT)
        while k < near:
            if a[i + k] != a[j + k]:
                return k
            k += 1
        if k == most:
            return k
        h, power = self._hashes()
        differ = lambda m: ((h[i + m] - h[j + m]) - (h[i] - h[j]) * power[m]) % _PRIME
        step = k
        while k + step <= most and not differ(k + step):
            k, step = k + step, 2 * step
        high = min(most, k + step - 1)
        while k < high:
            mid = (k + high + 1) // 2
            if differ(mid):
                high = mid - 1
            else:
                k = mid
        return k

    def behind(self, i: int, j: int) -> int:
        """How many words before i equal those before j; i < j."""
        a = self.ids
        k, near = 0, min(i, DIRECT)
        while k < near:
            if a[i - k - 1] != a[j - k - 1]:
                return k
            k += 1
        if k == i:
            return k
        h, power = self._hashes()
        differ = lambda m: ((h[i] - h[j]) - (h[i - m] - h[j - m]) * power[m]) % _PRIME
        step = k
        while k + step <= i and not differ(k + step):
            k, step = k + step, 2 * step
        high = min(i, k + step - 1)
        while k < high:
            mid = (k + high + 1) // 2
            if differ(mid):
                high = mid - 1
            else:
                k = mid
        return k


def lyndon_lengths(words: Words, falling: bool) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place, in the order of ids or in the falling one.

    It ends where the next smaller suffix begins; a suffix that is the start of another is the smaller one.
    """
    ids, n, ahead = words.ids, words.n, words.ahead
    a = [-x for x in ids] if falling else ids
    out, stack = array("q", bytes(8 * n)), [n]
    pair, shared = -1, 0  # the last two suffixes compared, as one number, and how many words they share
    for i in range(n - 1, -1, -1):
        x, top = a[i], stack[-1]
        while top < n:
            y = a[top]
            if x > y:
                break
            if x == y:
                # Suffixes that follow compared ones share one word more than these.
                shared = shared + 1 if pair == (i + 1) * n + top + 1 else ahead(i, top)
                pair = i * n + top
                if top + shared == n or a[i + shared] > a[top + shared]:
                    break
            stack.pop()
            top = stack[-1]
        out[i] = top - i
        stack.append(i)
    return np.frombuffer(out, np.int64)


def _windows(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from each place on. Equal words have equal hashes; it only spares comparisons."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * _MIX + mixed[k : k + n]
    return out


def _candidates(lengths: np.ndarray, windows: np.ndarray, width: int, power: int) -> list[tuple[int, int]]:
    """(place, period) where a run may be: such a one goes on for ``width`` words to the right of its root's start, or to the left."""
    n, last = len(lengths), len(windows)
    at = np.flatnonzero(lengths <= n // power)
    right, left = at + lengths[at], at - width
    here = at[right < last]
    good = np.zeros(n, bool)
    good[here[windows[here] == windows[right[right < last]]]] = True
    fits = (left >= 0) & (right - width < last)
    here = at[fits]
    good[here[windows[left[fits]] == windows[right[fits] - width]]] = True
    places = np.flatnonzero(good)
    return list(zip(places.tolist(), lengths[places].tolist(), strict=True))


def _exact(words: Words, start: int, end: int, period: int) -> bool:
    """Whether words lie ``period`` apart throughout, and not beyond; by the words themselves."""
    a = words.ids
    return (
        a[start : end - period] == a[start + period : end]
        and (start == 0 or a[start - 1] != a[start - 1 + period])
        and (end == words.n or a[end] != a[end - period])
    )


def _stepped(words: Words, at: int, period: int) -> tuple[int, int]:
    """The stretch of ``period`` around ``at``, word by word."""
    a, start, end = words.ids, at, at + period
    while end < words.n and a[end] == a[end - period]:
        end += 1
    while start and a[start - 1] == a[start - 1 + period]:
        start -= 1
    return start, end


def runs_of(ids: list[int], least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. ``least_power`` is 2 or more."""
    if least_power < 2:
        raise ValueError("a run has at least two periods")
    n = len(ids)
    if n < max(least_length, least_power):
        return []
    words, width = Words(ids), max(1, (least_length - least_length // least_power) // 2)
    windows, found, ends = _windows(np.array(ids, np.int64), width), set(), {}
    if len(np.unique(windows)) == len(windows):
        return []  # a run holds some ``width`` words twice
    for falling in (False, True):
        ends.clear()
        for at, period in _candidates(lyndon_lengths(words, falling), windows, width, least_power):
            if at + period <= ends.get(period, 0):
                continue  # inside the last run of this period
            start, end = at - words.behind(at, at + period), at + period + words.ahead(at, at + period)
            if end - start < max(least_length, least_power * period):
                continue
            if not _exact(words, start, end, period):  # a hash collided
                start, end = _stepped(words, at, period)
                if end - start < max(least_length, least_power * period):
                    continue
            ends[period] = end
            found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, but for those that a run holds after its first period."""
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return b" ".join(compress(words, keep))


def periodic_runs(docs: DataFrame, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",), least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> DataFrame:
    """The columns ``keep`` with n_words, runs (an array of start, length, period) and collapsed (the text without repeats).

    Words are longest runs of characters other than ASCII white space, numbered from 0. A run has ``least_length`` words and
    ``least_power`` periods at least; its period is the smallest, and no neighbouring word goes on with it. Runs stand by start, then
    period. Null and empty texts, and texts without words, have no words, no runs and an empty collapsed text. Each row stands for
    itself, so repeated rows and null ids stay; an empty table stays empty. Columns outside ``keep`` are not read. A
    task holds one text's words at a time, some 30 bytes a word and 16 more where long stretches repeat; time is n log n at worst.
    """
    shape = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    names, struct = shape.names, pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])

    def made(batch: pa.RecordBatch, rows: list[tuple[int, list, bytes]], at: int) -> pa.RecordBatch:
        own = batch.slice(at, len(rows))
        offsets = np.cumsum([0, *[len(r) for _, r, _ in rows]], dtype=np.int32)
        flat = np.array([x for _, r, _ in rows for x in r], np.int64).reshape(-1, 3)
        runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(struct)))
        texts = pa.array([t for _, _, t in rows], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*[own.column(i) for i in range(len(keep))], pa.array([n for n, _, _ in rows], pa.int64()), runs, texts], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, size = [], 0, 0
            for text in batch.column(len(keep)):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                known: dict[bytes, int] = {}
                ids = [known.setdefault(w, len(known)) for w in words]
                found = runs_of(ids, least_length, least_power)
                rows.append((len(words), found, collapsed(words, found)))
                size += len(rows[-1][2])
                if size >= BATCH_BYTES:
                    yield made(batch, rows, at)
                    at, rows, size = at + len(rows), [], 0
            if rows:
                yield made(batch, rows, at)

    return docs.select(*[docs[c] for c in keep], docs[text_col].cast("binary")).mapInArrow(run, shape)


def with_digests(found: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` with n_runs, the start, length, period and exponent_milli of the run of most periods, and digests.

    Of runs with equally many periods the one with the smallest start counts, then the one with the smallest period.
    """
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    more = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), more)
    return found.withColumn("__best", best).select(
        *keep,
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"__best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * __best.length div __best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
