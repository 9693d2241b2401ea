"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words. Among all document rates between 0 and ``cap``, those are taken that
are closest, by relative entropy, to one copy of each document and meet the source's target. Their form is known:
``rate = min(cap, exp(lambda * size / scale))``, with one multiplier ``lambda`` a source, the optimum of a convex
dual. Newton steps on the logarithm of the dual's gradient find all multipliers at once; every step is one
aggregation over the table of (source, size) cells, which is far smaller than the documents: the different sizes
of a source with W words number fewer than sqrt(2 W).

Rates become copies from the largest size to the smallest. What one cell's copies miss or exceed is carried to the
next one, so a source ends within about its smallest documents of the target. Inside a cell the documents that
get one copy more are those of smallest hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juryframe.llm.common import cut, remove, unused, word_count, written

#: A cell of more documents than this, and than this share of all, is dealt by hash into parts of about so many, each of
#: which is ordered for itself. At most 1 / LARGE_SHARE cells can be that large.
LARGE_CELL, LARGE_SHARE = 1024, 1e-4
#: Points on each side of the Newton point.
LADDER = 6
NAMES = ("size", "source_size", "target", "rate", "copies")


def _source_key(source: Column) -> Column:
    """A never-null key that sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sizes`` (src, total) with ``target``: the shares by weight, none above ``cap`` times the total.

    The excess of sources at their limit is dealt to the others by weight until none is above. So every target is
    ``min(cap * total, theta * weight)`` for one theta, which the sources in order of limit over weight give.
    The windows here run over one row a source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    rated = (
        sizes.withColumn("rank", F.row_number().over(Window.orderBy("src")))
        .withColumn("weight", w)
        .withColumn("limit", F.col("total") * F.lit(float(cap)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("words", F.sum("total").over(everything) * F.lit(float(share)))
    )
    rising = Window.orderBy("ratio", "src")
    theta = (F.col("words") - F.coalesce(F.sum("limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    return (
        rated.withColumn("theta", theta)
        .withColumn("level", F.max(F.when(F.col("theta") <= F.col("ratio"), F.col("theta"))).over(everything))
        .select("src", "total", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight"))).alias("target"))
    )


def _solve(cells: DataFrame, targets: DataFrame, cap: float, tol: float, max_iter: int) -> DataFrame:
    """The multiplier ``lam`` of each source, by safeguarded Newton steps over all sources at once."""
    top = F.log(F.lit(float(cap)))
    seen = cells.filter("z > 0").groupBy("src").agg((F.sum(F.col("n") * F.col("z") * F.col("z")) / F.sum(F.col("n") * F.col("z"))).alias("scale"), F.min("z").alias("least"))
    full = F.col("target") >= F.col("total") * cap * (1 - 1e-12)
    below = F.col("target") < F.col("total")
    spark, scratch = cells.sparkSession, []
    state = written(
        targets.join(seen, "src", "left")
        .withColumn("scale", F.coalesce("scale", F.lit(1.0)))
        .withColumn("least", F.coalesce("least", F.lit(1)))
        .withColumn("reach", F.col("scale") / F.col("least"))
        .withColumn("lo", F.when(below, F.log(F.col("target") / F.col("total")) * F.col("reach")).otherwise(F.lit(0.0)))
        .withColumn("hi", F.when(below, F.lit(0.0)).otherwise(top * F.col("reach") * (1 + 1e-9)))
        .withColumn("lam", F.when((F.col("total") > 0) & full, F.col("hi")).otherwise(F.lit(0.0)))
        .select("src", "total", "target", "scale", "lo", "hi", "lam", (full | (F.col("total") == 0)).alias("done")),
        scratch,
    )
    tilt = F.exp(F.col("try") * F.col("z") / F.col("scale"))
    words = F.col("n") * F.col("z")
    # The gradient is taken at the Newton point and at points ever nearer to it on both sides, which narrow the bracket.
    tries = F.array("lam", *[F.col("lam") + (F.col(end) - F.col("lam")) * F.lit(4.0**-k) for end in ("lo", "hi") for k in range(1, LADDER + 1)])
    for _ in range(max_iter):
        if state.filter(~F.col("done")).isEmpty():
            for path in scratch[:-1]:
                remove(spark, path)
            return state
        sums = (
            cells.join(state.filter(~F.col("done")).select("src", "scale", "target", F.array_distinct(tries).alias("tries")), "src")
            .withColumn("try", F.explode("tries"))
            .withColumn("tilt", tilt)
            .groupBy("src", "target", "try")
            .agg(
                F.sum(words * F.least(F.col("tilt"), F.lit(float(cap)))).alias("got"),
                F.sum(F.when(F.col("tilt") < cap, words * F.col("z") / F.col("scale") * F.col("tilt")).otherwise(F.lit(0.0))).alias("slope"),
            )
            .withColumn("miss", F.abs(F.log(F.col("got") / F.col("target"))))
            .groupBy("src")
            .agg(
                F.max(F.when(F.col("got") <= F.col("target"), F.col("try"))).alias("above"),
                F.min(F.when(F.col("got") > F.col("target"), F.col("try"))).alias("below"),
                F.min(F.struct("miss", "try", "got", "slope")).alias("best"),
            )
        )
        step = F.col("best.try") - F.log(F.col("best.got") / F.col("target")) * F.col("best.got") / F.col("best.slope")
        stepped = (
            state.join(sums, "src", "left")
            .withColumn("near", F.col("done") | (F.abs(F.col("best.got") / F.col("target") - 1) < tol))
            .withColumn("lo", F.greatest("lo", "above"))
            .withColumn("hi", F.least("hi", "below"))
            .withColumn("step", F.when((F.col("best.got") > 0) & (F.col("best.slope") > 0), step))
            .withColumn("mid", (F.col("lo") + F.col("hi")) / 2)
            .withColumn("next", F.when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step")).otherwise(F.col("mid")))
        )
        settled = F.when(F.col("done"), F.col("lam")).when(F.col("near"), F.col("best.try")).otherwise(F.col("next"))
        state = written(stepped.select("src", "total", "target", "scale", "lo", "hi", settled.alias("lam"), F.col("near").alias("done")), scratch)
    raise RuntimeError(f"the multipliers did not settle in {max_iter} steps")


def _round_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies for each cell of one source, largest size first, carrying what was missed to the next cell."""
    pdf = pdf.sort_values("z", ascending=False)
    carry, out = 0.0, []
    for z, n, most, rate in zip(pdf["z"], pdf["n"], pdf["most"], pdf["rate"], strict=True):
        want = n * rate + (carry / z if z else 0.0)
        copies = min(max(int(want + 0.5), 0), int(n * most))
        carry += (n * rate - copies) * z
        out.append(copies)
    return pd.DataFrame({"src": pdf["src"], "z": pdf["z"], "n": pdf["n"], "rate": pdf["rate"], "copies": out})


def mix_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    tol: float = 1e-6,
    max_iter: int = 100,
    prefix: str = "mix_",
) -> DataFrame:
    """``docs`` with the number of copies that the mix takes of each row.

    Adds, each after ``prefix``, size (words of the text; null: 0), source_size, target (words its source should give),
    rate (copies wanted, 0 to ``cap``) and copies (whole copies, at most ``cap``); columns of these names are replaced,
    all others kept, whatever their names. A null source is a source of its own, after all others. Sources without words
    have target 0, and their documents one copy. Rows that repeat are rows of their own. An empty table stays empty. The
    outcome depends on ids, texts and sources alone, not on how rows are dealt to tasks. Rows of a cell are dealt by the
    hash of id and text; only rows with the same id, or none, and the same text stay together. Texts may be of any length: they are
    counted and hashed where they lie, and move only if the caller keeps them.
    """
    added = [prefix + n for n in NAMES]
    size, source_size, target, rate_name, copies_name = added
    own = docs.drop(*added)
    src, hashed, second, salt, before, n, taken, parts_of = unused([*own.columns, *added], "__src", "__hash", "__second", "__salt", "__before", "__n", "__copies", "__parts")
    # Two hashes of id and text order the rows of a cell, so that texts which the caller drops need not move.
    hashes = {hashed: F.xxhash64(F.col(id_col), F.col(text_col)), second: F.xxhash64(F.lit("second"), F.col(id_col), F.col(text_col))}
    keyed = own.withColumns({size: word_count(F.col(text_col)), src: _source_key(F.col(source_col)), **hashes})
    thin = cut(keyed.select(F.col(src).alias("src"), F.col(size).alias("z"), F.col(hashed).alias("h")))
    cells = cut(thin.groupBy("src", "z").agg(F.count(F.lit(1)).alias("n")))
    most = F.broadcast(cells.agg(F.greatest(F.lit(LARGE_CELL), F.ceil(F.sum("n") * F.lit(LARGE_SHARE))).alias("most")))  # one row
    # At most 1 / LARGE_SHARE rows.
    large = F.broadcast(cut(cells.join(most, how="cross").filter("n > most").select("src", "z", F.ceil(F.col("n") / F.col("most")).alias("parts"))))
    part = lambda h, parts: F.pmod(h, F.coalesce(parts, F.lit(1)))
    salted = cut(thin.join(large, ["src", "z"], "left").groupBy("src", "z", part(F.col("h"), F.col("parts")).alias("salt")).agg(F.count(F.lit(1)).alias("m")))
    targets = source_targets(cells.groupBy("src").agg(F.sum(F.col("z") * F.col("n")).alias("total")), weights, share, cap)
    state = _solve(cells, targets, cap, tol, max_iter)
    # A multiplier is cut to nine digits, so that the order of summation cannot show in the copies.
    rate = F.least(F.exp(F.round("lam", 9) * F.col("z") / F.col("scale")), F.lit(float(cap)))
    rated = cells.join(state, "src").select("src", "z", "n", F.lit(cap).alias("most"), rate.alias("rate"))
    copies = rated.groupBy("src").applyInPandas(_round_cells, "src string, z long, n long, rate double, copies long")
    ahead = F.coalesce(F.sum("m").over(Window.partitionBy("src", "z").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = (
        salted.withColumn("ahead", ahead)
        .join(copies, ["src", "z"])
        .join(state.select("src", "total", "target"), "src")
        .select(
            F.col("src").alias(src), F.col("z").alias(size), F.col("salt").alias(salt), F.col("ahead").alias(before), F.col("n").alias(n), F.col("copies").alias(taken),
            F.col("rate").alias(rate_name), F.col("total").alias(source_size), F.col("target").alias(target),
        )
    )
    dealt = keyed.join(large.select(F.col("src").alias(src), F.col("z").alias(size), F.col("parts").alias(parts_of)), [src, size], "left").withColumn(salt, part(F.col(hashed), F.col(parts_of)))
    place = F.col(before) + F.row_number().over(Window.partitionBy(src, size, salt).orderBy(hashed, F.col(id_col), second))
    count, rest = F.floor(F.col(taken) / F.col(n)), F.col(taken) % F.col(n)
    return dealt.join(cut(parts), [src, size, salt]).withColumn(copies_name, (count + F.when(place <= rest, 1).otherwise(0)).cast("int")).select(*own.columns, *added)


def take_copies(mixed: DataFrame, columns: list[str], *, prefix: str = "mix_") -> DataFrame:
    """The mix itself: each row of ``mix_documents`` as often as its copies say, with the given columns.

    Nothing is shuffled. Rows without copies, or whose copies are null, are left out; an empty table stays empty; nulls and texts of any
    length are passed on as they are, and repeated rows each count for themselves.
    """
    (copy,) = unused(mixed.columns, "__copy")
    return mixed.filter(F.col(prefix + "copies") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(prefix + "copies")))).select(*columns)
