"""Statistics of expert scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juryframe.functions.choice import argmax, argmin, at, oracle_label
from juryframe.operators.split import uniform
from juryframe.schema import EXPERTS, by_expert, rounded, score_array


def oracle_frequency(scores: DataFrame) -> DataFrame:
    counts = scores.select(oracle_label().alias("oracle_model")).groupBy("oracle_model").agg(F.count(F.lit(1)).alias("count"))
    share = F.col("count").cast("double") * 100.0 / F.sum("count").over(Window.partitionBy())
    return counts.withColumn("percentage", rounded(share, 2)).orderBy(F.desc("percentage"), "oracle_model")


def mean_scores(scores: DataFrame) -> DataFrame:
    return scores.agg(*[rounded(F.avg(f"{e}_wer"), 4).alias(f"{e}_mean") for e in EXPERTS])


def correlation(x: str, y: str) -> Column:
    """Pearson's; null where a column is constant or there is one row."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def score_correlation(scores: DataFrame) -> DataFrame:
    pairs = (("hubert", "w2v2"), ("hubert", "whisper"), ("w2v2", "whisper"))
    return scores.agg(*[rounded(correlation(f"{a}_wer", f"{b}_wer"), 4).alias(f"{a}_{b}_corr") for a, b in pairs])


def summary(x: str) -> list[Column]:
    """Mean, standard error (0 for one row) and count."""
    n = F.count(x)
    sem = F.coalesce(F.stddev_samp(x) / F.sqrt(n.cast("double")), F.lit(0.0))
    return [rounded(F.avg(x), 6).alias("wer_mean"), rounded(sem, 6).alias("wer_sem"), n.alias("n")]


def single_expert(scores: DataFrame) -> DataFrame:
    return by_expert(scores, ["split"]).groupBy("split", "expert").agg(*summary("wer"))


def oracle_baseline(scores: DataFrame) -> DataFrame:
    return scores.select("split", F.array_min(score_array()).alias("wer")).groupBy("split").agg(*summary("wer"))


def prior_weights(train: DataFrame) -> DataFrame:
    """One row: an array of weights in expert order, max(1 - mean, 1e-6) scaled to sum 1."""
    raw = F.array(*[F.greatest(1 - F.avg(f"{e}_wer"), F.lit(1e-6)) for e in EXPERTS])
    return train.agg(raw.alias("raw")).select(F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)).alias("weights"))


def random_pick(key: str, seed: int) -> Column:
    return F.floor(uniform(F.col(key), seed) * len(EXPERTS)).cast("int")


def random_baseline(scores: DataFrame, key: str, seed: int) -> DataFrame:
    return scores.select("split", at(score_array(), random_pick(key, seed)).alias("wer")).groupBy("split").agg(*summary("wer"))


def weighted_pick(key: str, seed: int, weights: Column) -> Column:
    """Index whose share of the unit interval holds the row's random number; the last one takes what rounding leaves."""
    sums = [F.lit(0.0)]
    for i in range(len(EXPERTS) - 1):
        sums.append(sums[-1] + F.get(weights, F.lit(i)))
    u, pick = uniform(F.col(key), seed), F.lit(0)
    for i in range(1, len(EXPERTS)):
        pick = F.when(u >= sums[i], i).otherwise(pick)
    return pick


def weighted_random_baseline(scores: DataFrame, key: str, seed: int) -> DataFrame:
    weights = prior_weights(scores.filter("split = 'train'"))  # one row
    picked = scores.join(F.broadcast(weights), how="cross").select("split", at(score_array(), weighted_pick(key, seed, F.col("weights"))).alias("wer"))
    return picked.groupBy("split").agg(*summary("wer"))


def random_accuracy(scores: DataFrame, key: str, seed: int) -> DataFrame:
    hit = (random_pick(key, seed) == argmin(score_array())).cast("double")
    return scores.groupBy("split").agg(rounded(F.avg(hit), 6).alias("value"), F.count(F.lit(1)).alias("n"))


def class_priors(train: DataFrame, experts: tuple[str, ...] = EXPERTS) -> DataFrame:
    """(expert, n, prior): how often each is the best; experts that never are have 0."""
    label = argmin(score_array(experts))
    counts = train.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(label == i).alias(f"c{i}") for i in range(len(experts))])
    rows = F.array(*[F.struct(F.lit(e).alias("expert"), F.col(f"c{i}").alias("n")) for i, e in enumerate(experts)])
    return counts.select("total", F.explode(rows).alias("r")).select("r.expert", "r.n", F.try_divide(F.col("r.n").cast("double"), F.col("total")).alias("prior"))


#: Priors where none are computed, in expert order.
FALLBACK_PRIORS = (0.323, 0.444, 0.233)


def priors_or_fallback(priors: DataFrame) -> DataFrame:
    """(expert, prior): those of ``class_priors``, but where no row was counted the fixed ones."""
    fixed = F.map_from_arrays(F.array(*[F.lit(e) for e in EXPERTS]), F.array(*[F.lit(p) for p in FALLBACK_PRIORS]))
    return priors.select("expert", F.coalesce("prior", fixed[F.col("expert")]).alias("prior"))


def class_weights(priors: DataFrame) -> DataFrame:
    """(expert, weight): 1 / prior, 0 for a prior of 0, scaled to sum to the number of experts."""
    inverse = F.when(F.col("prior") > 0, 1 / F.col("prior")).otherwise(0.0)
    whole = Window.partitionBy()
    return priors.withColumn("raw", inverse).select("expert", (F.col("raw") / F.sum("raw").over(whole) * F.count(F.lit(1)).over(whole)).alias("weight"))


def medians(long: DataFrame) -> DataFrame:
    """(expert, median), exact, of (expert, wer).

    Equal scores are counted where they lie. The one or two middle places of an expert are looked up among the counts by
    ranges of scores, then within the ranges that hold them, so no task holds an expert's scores.
    """
    counts = long.filter("wer is not null").groupBy("expert", "wer").agg(F.count(F.lit(1)).alias("n"))
    limits = counts.groupBy("expert").agg(F.min("wer").alias("least"), F.max("wer").alias("most"), F.sum("n").alias("total"))
    width = F.col("most") - F.col("least")
    ranged = counts.join(F.broadcast(limits), "expert").withColumn("range", F.when(width > 0, F.floor((F.col("wer") - F.col("least")) / width * MEDIAN_RANGES)).otherwise(F.lit(0)))
    # At most MEDIAN_RANGES + 1 rows an expert.
    sums = ranged.groupBy("expert", "range").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("expert").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("expert", "range", "m", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    places = F.array_distinct(F.array(F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")))
    wanted = limits.select("expert", F.explode(places).alias("place")).join(starts, "expert").filter("place > start and place <= start + m").select("expert", "range", "place", "start")
    upto = Window.partitionBy("expert", "range").orderBy("wer")
    inside = ranged.join(F.broadcast(wanted.select("expert", "range", "start").distinct()), ["expert", "range"]).withColumn("end", F.col("start") + F.sum("n").over(upto))
    found = inside.join(F.broadcast(wanted.select("expert", "range", "place")), ["expert", "range"]).filter("place <= end and place > end - n")
    return found.groupBy("expert").agg(F.avg("wer").alias("median"))


#: Ranges into which ``medians`` divides an expert's scores.
MEDIAN_RANGES = 1000


def legacy_stats(scores: DataFrame) -> DataFrame:
    """(expert, mean, median, std, best_count); every expert that ties for the best is counted."""
    long = by_expert(scores.withColumn("best", F.array_min(score_array())), ["best"])
    rest = long.groupBy("expert").agg(
        rounded(F.avg("wer"), 6).alias("mean"),
        rounded(F.stddev_pop("wer"), 6).alias("std"),
        F.count_if(F.col("wer") == F.col("best")).alias("best_count"),
    )
    return rest.join(medians(long), "expert", "left").select("expert", "mean", rounded(F.col("median"), 6).alias("median"), "std", "best_count")


def best_single(scores: DataFrame) -> DataFrame:
    return legacy_stats(scores).select("expert", "mean").orderBy("mean", "expert").limit(1)


def win_rates(scores: DataFrame) -> DataFrame:
    """(expert, wins, win_rate, mean, oracle_mean), wins to the first of equals."""
    label, best = argmin(score_array()), F.array_min(score_array())
    return (
        by_expert(scores.select("*", label.alias("label"), best.alias("best")), ["label", "best"])
        .groupBy("expert")
        .agg(
            F.count_if(F.col("label") == F.col("expert_idx")).alias("wins"),
            rounded(F.avg((F.col("label") == F.col("expert_idx")).cast("double")), 6).alias("win_rate"),
            rounded(F.avg("wer"), 6).alias("mean"),
            rounded(F.avg("best"), 6).alias("oracle_mean"),
        )
    )


def score_limits(scores: DataFrame) -> DataFrame:
    return by_expert(scores, []).groupBy("expert").agg(F.min("wer").alias("low"), F.max("wer").alias("high"))


def _routed(routed: DataFrame, keys: list[str]) -> DataFrame:
    choice, oracle = argmax(F.col("probs")), argmin(score_array())
    return routed.select(*keys, choice.alias("choice"), oracle.alias("oracle"), at(score_array(), choice).alias("selected"), F.array_min(score_array()).alias("best"))


def _metrics(places: int) -> list[Column]:
    means = {
        "selected_wer": F.col("selected"),
        "oracle_wer": F.col("best"),
        "wer_gap": F.col("selected") - F.col("best"),
        "selection_accuracy": (F.col("choice") == F.col("oracle")).cast("double"),
        **{f"freq_{e}": (F.col("choice") == i).cast("double") for i, e in enumerate(EXPERTS)},
    }
    return [*[rounded(F.avg(x), places).alias(name) for name, x in means.items()], F.count(F.lit(1)).alias("n")]


def _grouped(rows: DataFrame, keys: list[str]):
    """Groups by all keys, by each prefix and suffix of them, and the whole; all in one pass."""
    if not keys:
        return rows.groupBy()
    sets = {tuple(keys[i:j]) for i in range(len(keys) + 1) for j in range(i, len(keys) + 1)}
    return rows.groupingSets([[F.col(k) for k in s] for s in sorted(sets)], *[F.col(k) for k in keys])


def router_metrics(routed: DataFrame, keys: list[str] | None = None, places: int = 6) -> DataFrame:
    """Over ``routed`` (scores and probs): the scores of the choice and the oracle, accuracy and frequencies.

    One row; with ``keys`` (a run, a split) one for each of their values and combinations and one for the whole, in which keys
    that a row sums over are null.
    """
    keys = keys or []
    return _grouped(_routed(routed, keys), keys).agg(*_metrics(places))


def confusion_matrix(routed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row for each oracle class with the share of each choice; a class that never is the oracle has zeros. ``keys`` as in ``router_metrics``."""
    keys, k = keys or [], range(len(EXPERTS))
    hits = [F.count_if((F.col("oracle") == i) & (F.col("choice") == j)).alias(f"n{i}{j}") for i in k for j in k]
    counts = _grouped(_routed(routed, keys), keys).agg(*hits)
    total = lambda i: sum((F.col(f"n{i}{j}") for j in k), F.lit(0))
    share = lambda i, j: F.when(total(i) > 0, F.col(f"n{i}{j}").cast("double") / total(i)).otherwise(0.0)
    rows = F.array(*[F.struct(F.lit(EXPERTS[i]).alias("oracle"), *[rounded(share(i, j), 6).alias(f"to_{EXPERTS[j]}") for j in k]) for i in k])
    return counts.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def _corpus_sums() -> tuple[Column, Column]:
    """(edits, reference words): an empty reference is one word that must be substituted."""
    n = F.when(F.col("n_ref") == 0, 1).otherwise(F.col("n_ref"))
    return F.sum(F.when(F.col("n_ref") == 0, F.greatest(F.col("n_hyp"), F.lit(1))).otherwise(F.col("edits"))), F.sum(n)


def corpus_rate() -> Column:
    edits, n = _corpus_sums()
    return rounded(edits / n, 6)


def corpus_error_rate(clips: DataFrame) -> DataFrame:
    """Sum of edits over sum of reference words by expert."""
    edits, n = _corpus_sums()
    return clips.groupBy("expert").agg(edits.cast("long").alias("edits"), n.cast("long").alias("n_ref"), corpus_rate().alias("wer_corpus"))
