"""Queries about routers: several runs and splits in one pass, pooled experts through dense layers, resumable results."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juryframe.functions.choice import at
from juryframe.operators import dense, results, stats
from juryframe.plans.fragments import FRAMES, SPLIT
from juryframe.plans.registered import query, r
from juryframe.schema import EXPERTS, rounded, score_array
from juryframe.sources import adapters, places, row_groups

RUNS = f"""{SPLIT},
scored AS (
  SELECT 'run0' AS run, *, hubert_wer AS a, whisper_wer AS b, w2v2_wer AS c FROM split
  UNION ALL SELECT 'run1', *, whisper_wer, w2v2_wer, hubert_wer FROM split
  UNION ALL SELECT 'run2', *, w2v2_wer, hubert_wer, whisper_wer FROM split),
chosen AS (SELECT *, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS choice FROM scored),
routed AS (SELECT *, CASE choice WHEN 0 THEN hubert_wer WHEN 1 THEN whisper_wer ELSE w2v2_wer END AS selected FROM chosen)"""
SETS = "GROUPING SETS ((run, split), (run), (split), ())"


#: Decimal places of the metrics; a mean of hundredths over a split is seldom half-way between two such numbers.
PLACES = 9


@query(f"""WITH {RUNS} SELECT run, split, {r("avg(selected)", PLACES)} AS selected_wer, {r("avg(best)", PLACES)} AS oracle_wer, {r("avg(selected - best)", PLACES)} AS wer_gap,
{r("avg(CASE WHEN choice = label THEN 1.0::DOUBLE ELSE 0.0 END)", PLACES)} AS selection_accuracy,
{", ".join(f"{r(f'avg(CASE WHEN choice = {i} THEN 1.0::DOUBLE ELSE 0.0 END)', PLACES)} AS freq_{e}" for i, e in enumerate(EXPERTS))}, count(*) AS n FROM routed GROUP BY {SETS}""")
def router_metrics_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of three routers on every split, over their splits, over the routers and over all, in one pass."""
    return stats.router_metrics(adapters.run_probs(spark, sf_dir), ["run", "split"], PLACES)


@query(f"""WITH {RUNS}, names(oracle, i) AS (VALUES ('hubert', 0), ('whisper', 1), ('w2v2', 2)),
counts AS (SELECT run, split, {", ".join(f"count(*) FILTER (WHERE label = {i} AND choice = {j}) AS n{i}{j}" for i in range(3) for j in range(3))} FROM routed GROUP BY {SETS}),
cells AS (SELECT run, split, oracle, {", ".join(f"CASE i WHEN 0 THEN n0{j} WHEN 1 THEN n1{j} ELSE n2{j} END AS m{j}" for j in range(3))} FROM counts, names)
SELECT run, split, oracle, {", ".join(f"CASE WHEN m0 + m1 + m2 > 0 THEN {r(f'CAST(m{j} AS DOUBLE) / (m0 + m1 + m2)')} ELSE 0.0::DOUBLE END AS to_{e}" for j, e in enumerate(EXPERTS))} FROM cells""")
def confusion_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion matrix of three routers on every split, and of each, in one pass."""
    return stats.confusion_matrix(adapters.run_probs(spark, sf_dir), ["run", "split"])


#: Units of the hidden layer of ``expert_router``.
HIDDEN = 32
_WIDTH = sum(n for _, n in adapters.EXPERT_DIMS.values())


def _layer(vector: str, ins: int, outs: int, n: int) -> str:
    weight = f"sin(CAST(13 * o + 7 * i + {n} AS DOUBLE)) * sqrt(CAST(6 AS DOUBLE) / {ins + outs})"
    return f"list_transform(range(0, {outs}), lambda o: list_sum(list_transform(range(0, {ins}), lambda i: {vector}[i + 1] * {weight})))"


#: The series of the error function with (2 n + 1)!! by factorials; z is the number over the square root of 2.
_ERF = "2 / sqrt(pi()) * exp(-(x * x / 2)) * (x / sqrt(2.0::DOUBLE)) * list_sum(list_transform(range(0, 60), lambda n: pow(x * x, n) / exp(lgamma(2 * n + 2) - lgamma(n + 1) - n * ln(2.0::DOUBLE))))"


@query(f"""WITH {FRAMES}, means AS (SELECT clip_id, d, avg(CAST(x AS DOUBLE)) AS mean FROM (SELECT clip_id, unnest(embedding) AS x, unnest(range(0, 64)) AS d FROM frames) GROUP BY clip_id, d),
experts AS ({" UNION ALL ".join(f"SELECT clip_id, {i} AS e, d, mean FROM means WHERE d >= {at_} AND d < {at_ + n}" for i, (at_, n) in enumerate(adapters.EXPERT_DIMS.values()))}),
pooled AS (SELECT clip_id, list(mean ORDER BY e, d) AS v FROM experts GROUP BY clip_id),
first AS (SELECT clip_id, {_layer("v", _WIDTH, HIDDEN, 0)} AS h FROM pooled),
hidden AS (SELECT clip_id, list_transform(h, lambda x: 0.5 * x * (1 + {_ERF})) AS g FROM first),
logits AS (SELECT clip_id, {_layer("g", HIDDEN, 3, 1)} AS z FROM hidden),
powers AS (SELECT clip_id, list_transform(z, lambda x: exp(x - list_max(z))) AS p FROM logits)
SELECT clip_id, {", ".join(f"{r(f'p[{i + 1}] / list_sum(p)')} AS {e}" for i, e in enumerate(EXPERTS))} FROM powers""")
def expert_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing probabilities of the mean frames of three experts side by side, through two dense layers."""
    pooled = dense.pool_experts(adapters.expert_segments(spark, sf_dir), "clip_id")
    weights = spark.range(1).select(dense.waves((_WIDTH, HIDDEN, len(EXPERTS))).alias("layers"))  # one row
    probs = pooled.join(F.broadcast(weights), how="cross").select("clip_id", dense.route(F.col("pooled"), F.col("layers"), 2).alias("p"))
    return probs.select("clip_id", *[rounded(F.get("p", F.lit(i)), 6).alias(e) for i, e in enumerate(EXPERTS)])


#: Units of ``resumed_results`` and the index of the expert that each chooses, in Spark and in SQL.
_U = "CAST(floor(u * 3) AS INTEGER)"
UNITS = {"hubert": "hubert_wer", "whisper": "whisper_wer", "w2v2": "w2v2_wer", "oracle": "best", "random": f"CASE {_U} WHEN 0 THEN hubert_wer WHEN 1 THEN whisper_wer ELSE w2v2_wer END"}


def _unit_sql(unit: str, wer: str) -> str:
    sem = "coalesce(stddev_samp(wer) / sqrt(CAST(count(wer) AS DOUBLE)), 0.0)"
    rows = {"wer_mean": r("avg(wer)"), "wer_sem": r(sem), "n": "CAST(count(wer) AS DOUBLE)"}
    return " UNION ALL ".join(f"SELECT '{unit}' AS unit, split, '{m}' AS metric, {x} AS value FROM (SELECT split, {wer} AS wer FROM split) GROUP BY split" for m, x in rows.items())


@query(f"WITH {SPLIT} " + " UNION ALL ".join(_unit_sql(u, wer) for u, wer in UNITS.items()))
def resumed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, errors and counts of several ways to choose, each a unit of a table that is filled in two goes and read back."""
    newest = row_groups.files(spark, f"{sf_dir}/lineitem.parquet").agg(F.max(F.unix_millis("modified"))).first()[0]
    path = f"{places.shared_dir(spark)}/results-{hashlib.md5(f'{sf_dir} {newest}'.encode()).hexdigest()}"
    scores = adapters.split_scores(spark, sf_dir)
    ways = {e: F.col(f"{e}_wer") for e in EXPERTS} | {"oracle": F.array_min(score_array()), "random": at(score_array(), stats.random_pick("clip_id", 42))}

    def work(units: list[str]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(u).alias(results.UNIT), ways[u].alias("wer")) for u in units])
        rows = scores.select("split", F.explode(each).alias("r")).select("split", "r.*").groupBy(results.UNIT, "split").agg(*stats.summary("wer"))
        return results.long(rows.withColumn("n", F.col("n").cast("double")), [results.UNIT, "split"], ["wer_mean", "wer_sem", "n"])

    results.fill_together(spark, path, list(UNITS)[:2], work)
    results.fill_together(spark, path, UNITS, work)
    return results.read(spark, path)
