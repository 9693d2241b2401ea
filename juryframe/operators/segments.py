"""Sequences of frames stored in parts, so that a sequence of any length is many short rows: (key, part, start, frames).

A part has at most ``PART`` frames, ``start`` is the place of its first one in the sequence, and all frames are equally wide. Every operator
works on a part for itself; what it needs of the whole sequence is its length, one number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juryframe.functions import frames as fr
from juryframe.operators.series import placed

#: Frames in a part.
PART = 256


def segmented(rows: DataFrame, key: str, order: str, frame: str, part_rows: int = PART, span: int = 1 << 18) -> DataFrame:
    """Parts of the sequences whose frames are rows of ``rows``, by ``order``, an integer; ``span`` as in ``placed``."""
    numbered = placed(rows.select(key, order, frame), [key], [order], span, "__place")
    own = F.sort_array(F.collect_list(F.struct("__place", frame)))
    parts = numbered.groupBy(key, F.floor(F.col("__place") / part_rows).alias("part")).agg(F.transform(own, lambda f: f[frame]).alias("frames"))
    return parts.select(key, "part", (F.col("part") * part_rows).alias("start"), "frames")


def lengths(parts: DataFrame, key: str) -> DataFrame:
    """(key, length) of every sequence."""
    return parts.groupBy(key).agg(F.sum(F.size("frames")).alias("length"))


def truncate(parts: DataFrame, longest: int) -> DataFrame:
    """The first ``longest`` frames of every sequence."""
    return parts.filter(F.col("start") < longest).withColumn("frames", F.slice("frames", F.lit(1), (F.lit(longest) - F.col("start")).cast("int")))


def trim(parts: DataFrame, valid: Column) -> DataFrame:
    """The first ``valid`` frames of each sequence, a number that a part can tell; the rest is padding."""
    left = F.least(F.greatest(valid - F.col("start"), F.lit(0)), F.size("frames")).cast("int")
    return parts.withColumn("frames", F.slice("frames", F.lit(1), left)).filter(F.size("frames") > 0)


def pad(parts: DataFrame, key: str, width: int, to: int | None = None, part_rows: int = PART) -> DataFrame:
    """``parts`` with mask (true for each frame), and parts of zero frames (mask false) from each sequence's end to ``to`` frames.

    Without ``to`` that is the length of the longest sequence. Frames don't move: only lengths are gathered, and what is padded is made
    from them, part by part.
    """
    sizes = lengths(parts, key)
    if to is None:
        goal = sizes.agg(F.max("length").alias("to"))  # one row
        sizes = sizes.join(F.broadcast(goal), how="cross")
    else:
        sizes = sizes.withColumn("to", F.lit(to).cast("long"))
    first, last = F.floor(F.col("length") / part_rows), F.floor((F.col("to") - 1) / part_rows)
    missing = sizes.filter("length < to").withColumn("part", F.explode(F.sequence(first, last)))
    start = F.greatest("length", F.col("part") * part_rows)
    n = (F.least("to", (F.col("part") + 1) * part_rows) - start).cast("int")
    zero = F.array_repeat(F.lit(0.0).cast(parts.schema["frames"].dataType.elementType.elementType), width)
    added = missing.select(key, "part", start.alias("start"), F.array_repeat(zero, n).alias("frames"), F.array_repeat(F.lit(False), n).alias("mask"))
    return parts.select(key, "part", "start", "frames", F.transform("frames", lambda _: F.lit(True)).alias("mask")).unionByName(added)


def split_at(parts: DataFrame, position: Column) -> DataFrame:
    """``parts`` with first and second: a part's frames before the sequence's frame number ``position``, and from it on."""
    before = F.least(F.greatest(position - F.col("start"), F.lit(0)), F.size("frames")).cast("int")
    first, second = fr.split_at(F.col("frames"), before)
    return parts.withColumns({"first": first, "second": second})


def pooled(parts: DataFrame, key: str) -> DataFrame:
    """(key, pooled): each sequence's mean frame; sums are made where the parts lie, and a group holds one number a dimension."""
    means = fr.mean_pool(parts, key, "frames")
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "mean"))), lambda m: m["mean"]).alias("pooled"))


def flat_values(parts: DataFrame, key: str, width: int) -> DataFrame:
    """(position, value): the numbers of all sequences one after another, by ``key``, an integer, then frame, then dimension.

    A sequence begins where the lengths of those before it end, by sums over ranges of the key; a part begins ``start`` frames later. So no
    window passes over values or parts.
    """
    begins = fr.offsets(lengths(parts, key), key, "length").select(F.col(key).alias("__key"), F.col("offset").alias("__offset"))
    at = (F.col("__offset") + F.col("start")) * width
    rows = parts.join(begins, F.col(key) == F.col("__key")).select(at.alias("__at"), F.posexplode(F.flatten("frames")).alias("__i", "value"))
    return rows.select((F.col("__at") + F.col("__i")).alias("position"), "value")


def nested(values: DataFrame, sizes: DataFrame, key: str, width: int, part_rows: int = PART) -> DataFrame:
    """Parts from (position, value) and the sequences' (key, length) in order of ``key``, an integer: ``flat_values`` turned back.

    A part's values lie side by side. They find it by ranges of ``part_rows`` frames of positions, of which a part meets two at most, so
    this is a join on equal numbers. Values beyond the last sequence are left out.
    """
    begins = fr.offsets(sizes.select(key, "length"), key, "length").filter("length > 0")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / part_rows)))
    spans = begins.select(key, "offset", "length", part.alias("part"))
    first = F.col("offset") + F.col("part") * part_rows
    last = F.col("offset") + F.least("length", (F.col("part") + 1) * part_rows) - 1
    spans = spans.select(key, "part", first.alias("__first"), last.alias("__last"))
    spans = spans.withColumn("__range", F.explode(F.array_distinct(F.array(F.floor(F.col("__first") / part_rows), F.floor(F.col("__last") / part_rows)))))
    frame = F.floor(F.col("position") / width)
    rows = values.select(frame.alias("__frame"), (F.col("position") % width).alias("__d"), "value").withColumn("__range", F.floor(F.col("__frame") / part_rows))
    found = rows.join(spans, "__range").filter("__frame between __first and __last")
    grouped = found.groupBy(key, "part", "__first").agg(F.sort_array(F.collect_list(F.struct("__frame", "__d", "value"))).alias("v"))
    n = (F.size("v") / width).cast("int")
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.slice("v", i * width + 1, F.lit(width)), lambda x: x["value"]))
    return grouped.select(key, "part", (F.col("part") * part_rows).alias("start"), frames.alias("frames"))
