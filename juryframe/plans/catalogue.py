"""Named queries over the driver tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juryframe.functions import choice, frames, text
from juryframe.operators import combine, pca, report, router, segments, series, split, stats, synthetic, voting
from juryframe.plans import assembly, routing, storage  # noqa: F401  their queries are entered too
from juryframe.plans.fragments import FRAMES, LABELLED, SCORES, SPLIT, STEPS
from juryframe.plans.registered import QUERIES, SQL, query, r  # noqa: F401
from juryframe.schema import EXPERTS, rounded, score_array
from juryframe.sources import adapters
from juryframe.sources.adapters import table

SEED, TAU, SMOOTHING = 42, 0.5, 0.1
#: Shares of the total loss: chosen score, hard and soft cross-entropy.
LOSS_SHARES = (1.0, 0.5, 0.5)


LONG = """SELECT split, 'hubert' AS expert, 0 AS i, hubert_wer AS wer, label, best FROM split
  UNION ALL SELECT split, 'whisper', 1, whisper_wer, label, best FROM split
  UNION ALL SELECT split, 'w2v2', 2, w2v2_wer, label, best FROM split"""
SUMMARY = f"""{r("avg(wer)")} AS wer_mean, {r("coalesce(stddev_samp(wer) / sqrt(CAST(count(wer) AS DOUBLE)), 0.0)")} AS wer_sem, count(wer) AS n"""
WEIGHTS = """raw AS (SELECT greatest(1 - avg(hubert_wer), 1e-6) AS a, greatest(1 - avg(whisper_wer), 1e-6) AS b, greatest(1 - avg(w2v2_wer), 1e-6) AS c FROM split WHERE split = 'train'),
weights AS (SELECT a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM raw)"""
PROBS = f"""{LABELLED},
powers AS (SELECT *, exp(-whisper_wer / 0.5 - m) AS e0, exp(-w2v2_wer / 0.5 - m) AS e1, exp(-hubert_wer / 0.5 - m) AS e2,
           exp((best - hubert_wer) / 0.5) AS t0, exp((best - whisper_wer) / 0.5) AS t1, exp((best - w2v2_wer) / 0.5) AS t2
           FROM (SELECT *, greatest(-hubert_wer / 0.5, -whisper_wer / 0.5, -w2v2_wer / 0.5) AS m FROM labelled)),
probs AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2,
          t0 / (t0 + t1 + t2) AS q0, t1 / (t0 + t1 + t2) AS q1, t2 / (t0 + t1 + t2) AS q2 FROM powers),
chosen AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS choice FROM probs),
routed AS (SELECT *, CASE choice WHEN 0 THEN hubert_wer WHEN 1 THEN whisper_wer ELSE w2v2_wer END AS selected FROM chosen)"""
CLIP_TEXT = """clip_text AS (SELECT conv_id * 1000 + turn AS clip_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS ref FROM conversations)"""
#: The distance is walked along the antidiagonals of the table of prefixes, as DuckDB's own counts bytes; needs WITH RECURSIVE.
HYPOTHESES = f"""{CLIP_TEXT},
hyps AS (
  SELECT clip_id, ref, 'hubert' AS expert, list_filter(ref, lambda x, i: i % 5 <> 0) AS hyp FROM clip_text
  UNION ALL SELECT clip_id, ref, 'whisper', flatten(list_transform(ref, lambda x, i: CASE WHEN i % 7 = 0 THEN [x, x] ELSE [x] END)) FROM clip_text
  UNION ALL SELECT clip_id, ref, 'w2v2', list_transform(ref, lambda x, i: CASE WHEN i % 4 = 0 THEN reverse(x) ELSE x END) FROM clip_text),
known AS (SELECT *, list_distinct(list_concat(ref, hyp)) AS v FROM hyps),
coded AS (SELECT clip_id, expert, list_transform(ref, lambda x: list_position(v, x)) AS a, list_transform(hyp, lambda x: list_position(v, x)) AS b FROM known),
walk(clip_id, expert, a, b, k, low, older, newer) AS (
  SELECT clip_id, expert, a, b, 0, 0, CAST([] AS BIGINT[]), CAST([0] AS BIGINT[]) FROM coded
  UNION ALL
  SELECT clip_id, expert, a, b, k + 1, greatest(0, k + 1 - len(b)), newer,
         list_transform(range(greatest(0, k + 1 - len(b)), least(k + 1, len(a)) + 1), lambda i: CASE WHEN i = 0 OR i = k + 1 THEN k + 1
           ELSE least(newer[i - low + 1] + 1, newer[i - low] + 1, older[i - greatest(0, k - 1 - len(b))] + CASE WHEN a[i] = b[k + 1 - i] THEN 0 ELSE 1 END) END)
  FROM walk WHERE k < len(a) + len(b)),
edits AS (SELECT clip_id, expert, len(a) AS n_ref, len(b) AS n_hyp, newer[1] AS edits FROM walk WHERE k = len(a) + len(b))"""
RESULTS = f"results AS (SELECT p_brand || '-seed' || p_size AS method, avg(p_retailprice) / {adapters.PRICE_UNIT} AS wer FROM part GROUP BY 1)"


# Scores ---------------------------------------------------------------------------------------------------------------
@query(f"""WITH {LABELLED}
SELECT CASE label WHEN 0 THEN 'hubert' WHEN 1 THEN 'whisper' ELSE 'w2v2' END AS oracle_model, count(*) AS count,
       {r("CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER ()", 2)} AS percentage
FROM labelled GROUP BY label""")
def oracle_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.oracle_frequency(adapters.scores(spark, sf_dir))


@query(f"""WITH {SCORES} SELECT {r("avg(hubert_wer)", 4)} AS hubert_mean, {r("avg(whisper_wer)", 4)} AS whisper_mean, {r("avg(w2v2_wer)", 4)} AS w2v2_mean FROM scores""")
def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean_scores(adapters.scores(spark, sf_dir))


def _corr(a: str, b: str) -> str:
    return f"covar_samp({a}_wer, {b}_wer) / nullif(stddev_samp({a}_wer) * stddev_samp({b}_wer), 0)"


@query(f"""WITH {SCORES} SELECT {r(_corr("hubert", "w2v2"), 4)} AS hubert_w2v2_corr, {r(_corr("hubert", "whisper"), 4)} AS hubert_whisper_corr,
{r(_corr("w2v2", "whisper"), 4)} AS w2v2_whisper_corr FROM scores""")
def score_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.score_correlation(adapters.scores(spark, sf_dir))


@query(f"""WITH {SCORES}, long AS (SELECT 'hubert' AS expert, hubert_wer AS wer FROM scores UNION ALL SELECT 'whisper', whisper_wer FROM scores UNION ALL SELECT 'w2v2', w2v2_wer FROM scores)
SELECT expert, min(wer) AS low, max(wer) AS high FROM long GROUP BY expert""")
def score_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.score_limits(adapters.scores(spark, sf_dir))


@query(f"""WITH {SCORES} SELECT clip_id, least(greatest(hubert_wer, 0.01), 1.0) AS hubert_wer, least(greatest(whisper_wer, 0.01), 1.0) AS whisper_wer, least(greatest(w2v2_wer, 0.01), 1.0) AS w2v2_wer FROM scores""")
def clip_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.scores(spark, sf_dir).select("clip_id", *[choice.clamp(F.col(f"{e}_wer"), 0.01, 1.0).alias(f"{e}_wer") for e in EXPERTS])


# Splits and baselines -------------------------------------------------------------------------------------------------
@query(f"WITH {SPLIT} SELECT clip_id, split FROM split")
def split_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.split_scores(spark, sf_dir).select("clip_id", "split")


@query(f"WITH {SPLIT} SELECT split, count(*) AS n FROM split GROUP BY split")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.split_scores(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SPLIT}, long AS ({LONG}) SELECT split, expert, {SUMMARY} FROM long GROUP BY split, expert")
def single_expert_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.single_expert(adapters.split_scores(spark, sf_dir))


@query(f"WITH {SPLIT} SELECT split, {SUMMARY} FROM (SELECT split, best AS wer FROM split) GROUP BY split")
def oracle_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.oracle_baseline(adapters.split_scores(spark, sf_dir))


@query(f"""WITH {SPLIT}, {WEIGHTS} SELECT 'hubert' AS expert, {r("p0")} AS weight FROM weights
UNION ALL SELECT 'whisper', {r("p1")} FROM weights UNION ALL SELECT 'w2v2', {r("p2")} FROM weights""")
def prior_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = stats.prior_weights(adapters.split_scores(spark, sf_dir).filter("split = 'train'"))
    names = F.array(*[F.lit(e) for e in EXPERTS])
    return weights.select(F.posexplode("weights").alias("i", "w")).select(F.get(names, F.col("i")).alias("expert"), rounded(F.col("w"), 6).alias("weight"))


PICK = "CASE CAST(floor(u * 3) AS INTEGER) WHEN 0 THEN hubert_wer WHEN 1 THEN whisper_wer ELSE w2v2_wer END"


@query(f"WITH {SPLIT} SELECT split, {SUMMARY} FROM (SELECT split, {PICK} AS wer FROM split) GROUP BY split")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.random_baseline(adapters.split_scores(spark, sf_dir), "clip_id", SEED)


@query(f"""WITH {SPLIT}, {WEIGHTS} SELECT split, {SUMMARY} FROM (
  SELECT split, CASE WHEN u >= p0 + p1 THEN w2v2_wer WHEN u >= p0 THEN whisper_wer ELSE hubert_wer END AS wer FROM split, weights) GROUP BY split""")
def weighted_random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_random_baseline(adapters.split_scores(spark, sf_dir), "clip_id", SEED)


@query(f"""WITH {SPLIT} SELECT split, {r("avg(CASE WHEN CAST(floor(u * 3) AS INTEGER) = label THEN 1.0::DOUBLE ELSE 0.0 END)")} AS value, count(*) AS n FROM split GROUP BY split""")
def random_selection_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.random_accuracy(adapters.split_scores(spark, sf_dir), "clip_id", SEED)


PRIORS = f"""{SPLIT}, names(expert, i) AS (VALUES ('hubert', 0), ('whisper', 1), ('w2v2', 2)),
priors AS (SELECT expert, (SELECT count(*) FROM split WHERE split = 'train' AND label = i) AS n,
           (SELECT count(*) FROM split WHERE split = 'train') AS total FROM names)"""


@query(f"WITH {PRIORS} SELECT expert, n, {r('CAST(n AS DOUBLE) / total')} AS prior FROM priors")
def class_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_priors(adapters.split_scores(spark, sf_dir).filter("split = 'train'")).withColumn("prior", rounded(F.col("prior"), 6))


@query(f"""WITH {PRIORS}, raw AS (SELECT expert, CASE WHEN n > 0 THEN total / CAST(n AS DOUBLE) ELSE 0.0 END AS w FROM priors)
SELECT expert, {r("w / sum(w) OVER () * 3")} AS weight FROM raw""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    priors = stats.class_priors(adapters.split_scores(spark, sf_dir).filter("split = 'train'"))
    return stats.class_weights(priors).withColumn("weight", rounded(F.col("weight"), 6))


LEGACY = f"""{SPLIT}, long AS ({LONG}),
legacy AS (SELECT expert, {r("avg(wer)")} AS mean, {r("median(wer)")} AS median, {r("stddev_pop(wer)")} AS std, count(*) FILTER (WHERE wer = best) AS best_count FROM long GROUP BY expert)"""


@query(f"WITH {LEGACY} SELECT * FROM legacy")
def legacy_expert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.legacy_stats(adapters.scores(spark, sf_dir))


@query(f"WITH {LEGACY} SELECT expert, mean FROM legacy ORDER BY mean, expert LIMIT 1")
def best_single_expert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.best_single(adapters.scores(spark, sf_dir))


@query(f"""WITH {SPLIT}, long AS ({LONG}) SELECT expert, count(*) FILTER (WHERE label = i) AS wins, {r("avg(CASE WHEN label = i THEN 1.0::DOUBLE ELSE 0.0 END)")} AS win_rate,
{r("avg(wer)")} AS mean, {r("avg(best)")} AS oracle_mean FROM long GROUP BY expert""")
def oracle_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.win_rates(adapters.scores(spark, sf_dir))


# A router's probabilities ---------------------------------------------------------------------------------------------
@query(f"""WITH {PROBS} SELECT {r("avg(selected)")} AS selected_wer, {r("avg(best)")} AS oracle_wer, {r("avg(selected - best)")} AS wer_gap,
{r("avg(CASE WHEN choice = label THEN 1.0::DOUBLE ELSE 0.0 END)")} AS selection_accuracy,
{", ".join(f"{r(f'avg(CASE WHEN choice = {i} THEN 1.0::DOUBLE ELSE 0.0 END)')} AS freq_{e}" for i, e in enumerate(EXPERTS))}, count(*) AS n FROM routed""")
def router_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.router_metrics(adapters.probs(spark, sf_dir))


@query(f"""WITH {PROBS}, names(oracle, i) AS (VALUES ('hubert', 0), ('whisper', 1), ('w2v2', 2)),
cells AS (SELECT oracle, {", ".join(f"count(*) FILTER (WHERE choice = {i}) AS n{i}" for i in range(3))}, count(choice) AS n FROM names LEFT JOIN routed ON label = i GROUP BY oracle)
SELECT oracle, {", ".join(f"CASE WHEN n > 0 THEN {r(f'CAST(n{i} AS DOUBLE) / n')} ELSE 0.0::DOUBLE END AS to_{e}" for i, e in enumerate(EXPERTS))} FROM cells""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.confusion_matrix(adapters.probs(spark, sf_dir))


@query(f"WITH {PROBS} SELECT clip_id, {r('q0')} AS hubert, {r('q1')} AS whisper, {r('q2')} AS w2v2 FROM probs")
def soft_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = adapters.scores(spark, sf_dir).select("clip_id", choice.soft_target(score_array(), TAU).alias("q"))
    return targets.select("clip_id", *[rounded(F.get("q", F.lit(i)), 6).alias(e) for i, e in enumerate(EXPERTS)])


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: expected_wer, hard_ce and soft_ce of the whole table."""
    p, w = F.col("probs"), score_array()
    labels = choice.argmin(w)
    weights = stats.class_weights(stats.class_priors(adapters.scores(spark, sf_dir)))
    lookup = F.map_from_entries(F.collect_list(F.struct("expert", "weight")))
    by_class = weights.agg(lookup.alias("m")).select(F.array(*[F.col("m")[e] for e in EXPERTS]).alias("class_weights"))  # one row
    rows = adapters.probs(spark, sf_dir).join(F.broadcast(by_class), how="cross")
    loss, weight = choice.hard_cross_entropy_terms(w, p, F.col("class_weights"), SMOOTHING)
    soft = choice.soft_cross_entropy(choice.soft_target(w, TAU), p)
    return rows.agg(F.avg(choice.dot(p, w)).alias("expected_wer"), (F.sum(loss) / F.sum(weight)).alias("hard_ce"), F.avg(soft).alias("soft_ce"), F.count(labels).alias("n"))


LOSSES = f"""{PROBS},
cw AS (SELECT [sum(w0) * 0 + max(a0), max(a1), max(a2)] AS w FROM (
   SELECT 0 AS w0, 3 * i0 / (i0 + i1 + i2) AS a0, 3 * i1 / (i0 + i1 + i2) AS a1, 3 * i2 / (i0 + i1 + i2) AS a2 FROM (
     SELECT {", ".join(f"CASE WHEN count(*) FILTER (WHERE label = {i}) > 0 THEN 1 / (CAST(count(*) FILTER (WHERE label = {i}) AS DOUBLE) / count(*)) ELSE 0.0 END AS i{i}" for i in range(3))} FROM labelled))),
logs AS (SELECT *, w, ln(p0 + 1e-8) AS l0, ln(p1 + 1e-8) AS l1, ln(p2 + 1e-8) AS l2, ln(p0 + p1 + p2 + 3e-8) AS z FROM probs, cw),
losses AS (SELECT avg(p0 * hubert_wer + p1 * whisper_wer + p2 * w2v2_wer) AS expected_wer,
  sum(-(CAST(0.9 AS DOUBLE) * w[label + 1] * ([l0, l1, l2][label + 1] - z) + CAST(0.1 AS DOUBLE) * (w[1] * (l0 - z) + w[2] * (l1 - z) + w[3] * (l2 - z)) / 3)) / sum(w[label + 1]) AS hard_ce,
  avg(-(q0 * l0 + q1 * l1 + q2 * l2)) AS soft_ce FROM logs)"""


@query(f"WITH {LOSSES} SELECT {r('expected_wer')} AS expected_wer FROM losses")
def expected_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir).select(rounded(F.col("expected_wer"), 6).alias("expected_wer"))


@query(f"WITH {LOSSES} SELECT {r('hard_ce')} AS hard_ce FROM losses")
def hard_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir).select(rounded(F.col("hard_ce"), 6).alias("hard_ce"))


@query(f"WITH {LOSSES} SELECT {r('soft_ce')} AS soft_ce FROM losses")
def soft_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir).select(rounded(F.col("soft_ce"), 6).alias("soft_ce"))


@query(f"WITH {LOSSES} SELECT {r('expected_wer + 0.5 * hard_ce + 0.5 * soft_ce')} AS total_loss FROM losses")
def total_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.lit(s) * F.col(c) for s, c in zip(LOSS_SHARES, ("expected_wer", "hard_ce", "soft_ce"), strict=True)]
    return _losses(spark, sf_dir).select(rounded(parts[0] + parts[1] + parts[2], 6).alias("total_loss"))


#: Steps of warm-up and in all.
WARMUP, TOTAL_STEPS = 50, 5000


@query(f"""WITH {STEPS} SELECT run, tag, step, {r(f"CASE WHEN step < {WARMUP} THEN step / CAST({WARMUP} AS DOUBLE) ELSE 0.5 * (1 + cos(3.141592653589793 * ((step - {WARMUP}) / CAST({TOTAL_STEPS - WARMUP} AS DOUBLE)))) END")} AS factor FROM steps""")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = choice.learning_rate_factor(F.col("step"), WARMUP, TOTAL_STEPS)
    return adapters.steps(spark, sf_dir).select("run", "tag", "step", rounded(factor, 6).alias("factor"))


# Text -----------------------------------------------------------------------------------------------------------------
CLEAN = r"regexp_replace(lower(coalesce(text, '{}')), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"


@query(f"""SELECT doc_id AS id, 'document' AS kind, trim({CLEAN.format('')}) AS clean, {CLEAN.format('None')} AS legacy FROM documents
UNION ALL SELECT conv_id * 1000 + turn, 'turn', trim({CLEAN.format('')}), {CLEAN.format('None')} FROM conversations""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [text.clean_text(F.col("text")).alias("clean"), text.clean_text_legacy(F.col("text")).alias("legacy")]
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), *both)
    return docs.unionByName(table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("id"), F.lit("turn").alias("kind"), *both))


@query(r"""SELECT conv_id * 1000 + turn AS clip_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM conversations""")
def tokenise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("clip_id"), F.size(text.tokens(F.col("text"))).alias("n_tokens"))


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.expert_hypotheses(spark, sf_dir)
    return rows.select("clip_id", "expert", F.size("ref").alias("n_ref"), F.size("hyp").alias("n_hyp"), text.word_distance(F.col("ref"), F.col("hyp")).alias("edits"))


@query(f"""WITH RECURSIVE {HYPOTHESES} SELECT clip_id, expert, CAST(n_ref AS INTEGER) AS n_ref, CAST(edits AS INTEGER) AS edits,
{r("CASE WHEN n_ref = 0 THEN 0.0 ELSE edits / CAST(n_ref AS DOUBLE) END")} AS wer FROM edits""")
def word_error_per_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = text.word_error_rate(F.col("edits"), F.col("n_ref"), F.col("n_hyp"))
    return _edited(spark, sf_dir).select("clip_id", "expert", "n_ref", "edits", rounded(rate, 6).alias("wer"))


@query(f"""WITH RECURSIVE {HYPOTHESES} SELECT expert, CAST(sum(CASE WHEN n_ref = 0 THEN greatest(n_hyp, 1) ELSE edits END) AS BIGINT) AS edits,
CAST(sum(CASE WHEN n_ref = 0 THEN 1 ELSE n_ref END) AS BIGINT) AS n_ref,
{r("CAST(sum(CASE WHEN n_ref = 0 THEN greatest(n_hyp, 1) ELSE edits END) AS DOUBLE) / sum(CASE WHEN n_ref = 0 THEN 1 ELSE n_ref END)")} AS wer_corpus FROM edits GROUP BY expert""")
def corpus_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corpus_error_rate(_edited(spark, sf_dir))


#: DuckDB's distance counts bytes, so each different character of a text becomes one in ASCII.
CHARS = "array_to_string(list_transform(string_split({}, ''), lambda x: chr(CAST(list_position(v, x) AS INTEGER))), '')"


@query(f"""WITH pairs AS (SELECT item_id, text AS ref, replace(text, 'e', '') AS hyp, list_distinct(string_split(text, '')) AS v FROM benchmark)
SELECT item_id, {r(f"CASE WHEN length(ref) = 0 OR length(hyp) = 0 THEN CASE WHEN ref = hyp THEN 0.0::DOUBLE ELSE 1.0 END ELSE levenshtein({CHARS.format('ref')}, {CHARS.format('hyp')}) / CAST(length(ref) AS DOUBLE) END")} AS cer FROM pairs""")
def char_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = text.char_error_rate(F.col("text"), F.replace("text", F.lit("e"), F.lit("")))
    return table(spark, sf_dir, "benchmark").select("item_id", rounded(rate, 6).alias("cer"))


@query("""SELECT DISTINCT p_brand AS name, replace(p_brand, '/', '_') AS file_name, substr(md5(p_brand), 1, 8) AS digest,
regexp_replace(p_brand || '_seed7', '[-_]seed\\d+$', '') AS base, replace('test/' || p_brand, 'test/', '') AS metric FROM part""")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_brand")
    return (
        table(spark, sf_dir, "part")
        .select(name.alias("name"), text.file_name(name).alias("file_name"), text.digest8(name).alias("digest"), text.without_seed(F.concat(name, F.lit("_seed7"))).alias("base"), text.without_prefix(F.concat(F.lit("test/"), name)).alias("metric"))
        .distinct()
    )


# Tables ---------------------------------------------------------------------------------------------------------------
@query(f"""WITH {SCORES} SELECT clip_id, CAST(clip_id AS VARCHAR) AS ground_truth, whisper_wer, hubert_wer, w2v2_wer FROM scores""")
def assemble_clip_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = adapters.scores(spark, sf_dir).withColumn("ground_truth", F.col("clip_id").cast("string"))
    parts = {e: base.select("clip_id", "ground_truth", f"{e}_wer") for e in EXPERTS}
    return combine.assemble(parts, "clip_id").select("clip_id", "ground_truth", "whisper_wer", "hubert_wer", "w2v2_wer")


@query("SELECT role, count(*) AS n FROM (SELECT * FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM conversations WHERE role = 'assistant' UNION ALL SELECT * FROM conversations WHERE role = 'system') GROUP BY role")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return combine.stack_rows([turns.filter(F.col("role") == x) for x in ("user", "assistant", "system")]).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT source AS dataset, expert FROM documents, (VALUES ('hubert'), ('whisper'), ('wav2vec2')) e(expert)")
def variant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.variant_grid(table(spark, sf_dir, "documents").select(F.col("source").alias("dataset")), ["hubert", "whisper", "wav2vec2", "unknown"])


@query("""SELECT n_name || '-seed' || s AS method, CAST(s AS INTEGER) AS seed FROM (SELECT n_name, unnest(range(1, n_regionkey + 1)) AS s FROM nation)
UNION ALL SELECT n_name, NULL FROM nation WHERE n_regionkey = 0""")
def seed_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = F.when(F.col("n_regionkey") > 0, F.sequence(F.lit(1), F.col("n_regionkey").cast("int")))
    return combine.expand_seeds(table(spark, sf_dir, "nation").select(F.col("n_name").alias("method"), seeds.alias("seeds")))


def _u(seed: int) -> str:
    return f"CAST(('0x' || substr(md5(concat('{seed}:', o_orderkey)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


def _regime_score(i: int) -> str:
    return f"CASE WHEN (regime_first + 2 * regime_second) % 3 = {i} THEN CAST(0.15 AS DOUBLE) ELSE 0.5 END"


CLIPS = f"""drawn AS (SELECT CAST(o_orderkey AS BIGINT) AS clip_id, CAST(floor({_u(42)} * 4) AS INTEGER) AS r1, CAST(floor({_u(43)} * 3) AS INTEGER) AS o,
          CAST(32 + floor({_u(44)} * 64) AS INTEGER) AS switch_position FROM orders),
clips AS (SELECT clip_id, r1 AS regime_first, CASE WHEN o >= r1 THEN o + 1 ELSE o END AS regime_second, switch_position FROM drawn),
scored AS (SELECT clips.*, {", ".join(f"{_regime_score(i)} AS {e}_wer" for i, e in enumerate(EXPERTS))} FROM clips),
cells AS (SELECT regime_first AS r1, regime_second AS r2, CAST(expert_idx AS INTEGER) AS expert_idx, avg(wer) AS wer FROM (
  {" UNION ALL ".join(f"SELECT regime_first, regime_second, {i} AS expert_idx, {e}_wer AS wer FROM scored" for i, e in enumerate(EXPERTS))}) GROUP BY ALL)"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated clips, one for each order."""
    return synthetic.clips(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id")), 4, 128)


@query(f"WITH {CLIPS} SELECT r1, r2, expert_idx, {r('wer')} AS wer FROM cells")
def regime_wer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.measured(_clips(spark, sf_dir)).withColumn("wer", rounded(F.col("wer"), 6))


@query(f"WITH {CLIPS} SELECT r1, r2, min({{'wer': {r('wer')}, 'i': expert_idx}}).i AS best FROM cells GROUP BY r1, r2")
def best_expert_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.best_expert(synthetic.measured(_clips(spark, sf_dir)).withColumn("wer", rounded(F.col("wer"), 6)))


@query(f"WITH {CLIPS} SELECT * FROM scored")
def synthetic_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir)


@query(f"""WITH {CLIPS} SELECT {r("avg(least(hubert_wer, whisper_wer, w2v2_wer))")} AS oracle, {r("avg((hubert_wer + whisper_wer + w2v2_wer) / 3)")} AS overall,
{", ".join(f"{r(f'avg({e}_wer)')} AS {e}_mean" for e in EXPERTS)} FROM scored""")
def synthetic_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = synthetic.sanity(_clips(spark, sf_dir))
    return found.select(*[rounded(F.col(c), 6).alias(c) for c in found.columns])


# Reports --------------------------------------------------------------------------------------------------------------
@query(f"""WITH {RESULTS}, named AS (SELECT *, regexp_replace(method, '[-_]seed\\d+$', '') AS base FROM results),
groups AS (SELECT base, avg(wer) AS wer, stddev_pop(wer) AS std, count(*) AS n, min(method) AS sole FROM named GROUP BY base)
SELECT 'Model: ' || CASE WHEN n > 1 THEN base || ' (mean)' ELSE sole END AS label, {r("wer")} AS wer, {r("CASE WHEN n > 1 THEN std ELSE 0.0 END")} AS std, n FROM groups
UNION ALL SELECT 'Model: ' || method, {r("named.wer")}, 0.0::DOUBLE, 1 FROM named JOIN groups USING (base) WHERE n > 1""")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.seed_summary(adapters.results(spark, sf_dir))


@query(f"""SELECT 'price_' || (l_linenumber % 2) AS metric, {r("avg(l_quantity)", 4)} AS value FROM lineitem GROUP BY 1""")
def checkpoint_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("checkpoint"), F.concat(F.lit("test/price_"), (F.col("l_linenumber") % 2).cast("string")).alias("metric"), F.col("l_quantity").alias("value"))
    return report.checkpoint_average(rows).withColumn("value", rounded(F.col("value"), 4))


@query("SELECT s_name AS checkpoint, s_acctbal AS value FROM supplier ORDER BY value, checkpoint LIMIT 3")
def top_k_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_checkpoints(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("checkpoint"), F.col("s_acctbal").alias("value")), 3)


@query(f"""WITH {STEPS} SELECT run, tag, step, {r("CASE WHEN count(*) OVER (PARTITION BY run, tag) < 5 THEN value ELSE sum(value) OVER (PARTITION BY run, tag ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE END", 4)} AS smooth FROM steps""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.moving_average(adapters.steps(spark, sf_dir), 5, ["run", "tag"], place="place").select("run", "tag", "step", rounded(F.col("smooth"), 4).alias("smooth"))


@query("SELECT doc_id, n_chars FROM (SELECT * FROM documents ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 25)")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 25, SEED)


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 100")
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").limit(100).select("conv_id", "turn", "role")


@query("SELECT CAST(p_size AS VARCHAR) AS r, min(p_retailprice) AS wer FROM part GROUP BY p_size ORDER BY p_size")
def numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.numeric_order(table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("string").alias("r")).agg(F.min("p_retailprice").alias("wer")), "r")


@query("""WITH wanted AS (SELECT CAST(range AS VARCHAR) AS r, m AS method FROM range(1, 61), (VALUES ('low'), ('high')) t(m)),
found AS (SELECT CAST(p_size AS VARCHAR) AS r, 'low' AS method, min(p_retailprice) AS value FROM part GROUP BY p_size)
SELECT r, method, value FROM wanted LEFT JOIN found USING (r, method)""")
def sweep_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("string").alias("r")).agg(F.min("p_retailprice").alias("value")).withColumn("method", F.lit("low"))
    wanted = spark.range(1, 61).select(F.col("id").cast("string").alias("r"), F.explode(F.array(F.lit("low"), F.lit("high"))).alias("method"))
    return report.sweep_series(found, wanted).select("r", "method", "value")


@query("""SELECT event_type AS method, 'mean' AS metric, floor(avg(value) * 1e4 + 0.5) / 1e4 AS value FROM events GROUP BY 1
UNION ALL SELECT event_type, 'n', CAST(count(*) AS DOUBLE) FROM events GROUP BY 1""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "events").groupBy("event_type").agg(F.struct(F.struct(rounded(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("gone")).alias("test")).alias("results"))
    return report.report_rows(documents, {"mean": "results.test.mean", "n": "results.test.n", "gone": "results.test.gone"}, F.col("event_type"))


# Frames ---------------------------------------------------------------------------------------------------------------
def _totals(parts: DataFrame) -> DataFrame:
    """(clip_id, t, total) of sequences in parts: the sum of each frame's numbers."""
    rows = parts.select("clip_id", "start", F.posexplode("frames").alias("t", "frame"))
    return rows.select("clip_id", (F.col("start") + F.col("t")).alias("t"), rounded(F.aggregate("frame", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


TOTAL = r("list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))", 4)


@query(f"WITH {FRAMES} SELECT clip_id, t, {TOTAL} AS total FROM frames WHERE t < 20")
def truncate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(segments.truncate(adapters.segments(spark, sf_dir), 20))


@query(f"WITH {FRAMES} SELECT clip_id, CAST(count(*) AS INTEGER) AS n FROM frames GROUP BY clip_id")
def frame_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("clip_id"), F.array("embedding").alias("frames"))
    return rows.groupBy("clip_id").agg(F.sum(frames.n_frames(F.col("frames"))).cast("int").alias("n"))


@query(f"""WITH {FRAMES}, sized AS (SELECT clip_id, count(*) AS n FROM frames GROUP BY clip_id)
SELECT clip_id, CAST(coalesce(sum(n) OVER (ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM sized""")
def frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("clip_id")).agg(F.count(F.lit(1)).alias("n"))
    return frames.offsets(sized, "clip_id", "n").select("clip_id", "offset")


@query(f"""WITH {FRAMES}, longest AS (SELECT max(n) AS m FROM frames), clips AS (SELECT DISTINCT clip_id, n FROM frames)
SELECT clip_id, CAST(m AS INTEGER) AS padded, CAST(m - n AS INTEGER) AS zeros, CAST(n AS INTEGER) AS masked FROM clips, longest""")
def pad_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = segments.pad(adapters.segments(spark, sf_dir), "clip_id", 64)
    zeros = F.size(F.filter("frames", lambda f: F.forall(f, lambda x: x == 0)))
    counts = {"padded": F.size("frames"), "zeros": zeros, "masked": F.size(F.filter("mask", lambda b: b))}
    return parts.groupBy("clip_id").agg(*[F.sum(n).cast("int").alias(c) for c, n in counts.items()])


@query(f"""WITH {FRAMES} SELECT clip_id, CAST(d AS INTEGER) AS d, {r("avg(CAST(x AS DOUBLE))", 5)} AS mean FROM (SELECT clip_id, unnest(embedding) AS x, unnest(range(0, 64)) AS d FROM frames) GROUP BY clip_id, d""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("clip_id"), F.array("embedding").alias("frames"))
    return frames.mean_pool(rows, "clip_id", "frames").select("clip_id", "d", rounded(F.col("mean"), 5).alias("mean"))


@query(f"WITH {FRAMES} SELECT clip_id, CAST(count(*) FILTER (WHERE t < 10 + clip_id) AS INTEGER) AS first, CAST(count(*) FILTER (WHERE t >= 10 + clip_id) AS INTEGER) AS second FROM frames GROUP BY clip_id")
def split_at_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = segments.split_at(adapters.segments(spark, sf_dir), F.col("clip_id") + 10)
    return parts.groupBy("clip_id").agg(*[F.sum(F.size(c)).cast("int").alias(c) for c in ("first", "second")])


@query(f"""SELECT row_number() OVER (ORDER BY label, vec_id, d) - 1 AS position, CAST(x AS DOUBLE) AS value
FROM (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS d FROM embeddings)""")
def flat_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.flat_values(adapters.segments(spark, sf_dir), "clip_id", 64)
    return found.select("position", F.col("value").cast("double").alias("value"))


@query("SELECT doc_id, least(1500, CAST(floor(n_chars / 320) AS BIGINT)) AS valid, CAST(floor(n_chars / 16000.0::DOUBLE * 50) AS BIGINT) AS legacy FROM documents WHERE n_chars > 1600")
def valid_frame_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.col("n_chars")
    return table(spark, sf_dir, "documents").filter(chars > 1600).select("doc_id", frames.valid_length(chars).alias("valid"), frames.valid_length_legacy(chars).alias("legacy"))


@query(f"""WITH {FRAMES}, codes AS (SELECT clip_id, t, unnest(range(0, 16)) AS i FROM frames)
SELECT clip_id, t, CAST(i AS INTEGER) AS i, {r("CASE WHEN i % 2 = 0 THEN sin(t * exp((i // 2) * 2 * (-9.210340371976184 / 16))) ELSE cos(t * exp((i // 2) * 2 * (-9.210340371976184 / 16))) END")} AS code FROM codes""")
def position_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = adapters.segments(spark, sf_dir).select("clip_id", "start", F.posexplode("frames").alias("t", "f")).select("clip_id", (F.col("start") + F.col("t")).alias("t"))
    return places.select("clip_id", "t", F.posexplode(frames.position_code(F.col("t"), 16)).alias("i", "x")).select("clip_id", "t", "i", rounded(F.col("x"), 6).alias("code"))


# Beyond SQL -----------------------------------------------------------------------------------------------------------
def _split_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split(adapters.hypotheses(spark, sf_dir), "clip_id")


def _expert_weights(clips: DataFrame) -> DataFrame:
    """One row: weights from the experts' mean error rates over the clips of the train split."""
    rate = lambda e: text.word_error_rate(text.word_distance_udf("ref", e), F.size("ref"), F.size(e))
    return stats.prior_weights(clips.filter("split = 'train'").select(*[rate(e).alias(f"{e}_wer") for e in EXPERTS]))


def _texts():
    return F.array(*[F.array_join(e, " ") for e in EXPERTS])


def _voted(clips: DataFrame, weights) -> DataFrame:
    return voting.evaluate(clips, _texts(), weights).select("clip_id", "split", "voted", "n_ref", "n_hyp", "edits", "wer")


def _equal_weights():
    return F.array(*[F.lit(1 / len(EXPERTS)) for _ in EXPERTS])


def _with_weights(clips: DataFrame) -> DataFrame:
    return clips.join(F.broadcast(_expert_weights(clips)), how="cross")


@query()
def rover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses combined with equal weights, and the error rate of each clip."""
    return _voted(_split_hypotheses(spark, sf_dir), _equal_weights())


@query()
def weighted_rover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses combined with weights from the train split, and the error rate of each clip."""
    return _voted(_with_weights(_split_hypotheses(spark, sf_dir)), F.col("weights"))


@query()
def rover_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, standard error and corpus rate of the combined hypotheses by split and method."""
    clips = _with_weights(_split_hypotheses(spark, sf_dir))
    each = clips.select("ref", "split", voting.combined_each(_texts(), F.array(_equal_weights(), "weights")).alias("voted"))
    both = voting.rated(each.select("ref", "split", F.explode(F.arrays_zip("voted", F.array(F.lit("rover"), F.lit("weighted_rover")).alias("method"))).alias("v")).select("ref", "split", "v.voted", "v.method"))
    return both.groupBy("split", "method").agg(*stats.summary("wer"), stats.corpus_rate().alias("wer_corpus"))


@query(f"""WITH RECURSIVE {HYPOTHESES},
ranked AS (SELECT clip_id, row_number() OVER (ORDER BY md5(concat('42:', clip_id)), clip_id) AS rn, count(*) OVER () AS n_total FROM clip_text),
means AS (SELECT expert, greatest(1 - avg(CASE WHEN n_ref = 0 THEN 0.0 ELSE edits / CAST(n_ref AS DOUBLE) END), 1e-6) AS raw
          FROM edits JOIN ranked USING (clip_id) WHERE rn <= floor(n_total * CAST(0.8 AS DOUBLE)) GROUP BY expert)
SELECT expert, {r("raw / sum(raw) OVER ()")} AS weight FROM means""")
def rover_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of weighted_rover."""
    names = F.array(*[F.lit(e) for e in EXPERTS])
    weights = _expert_weights(_split_hypotheses(spark, sf_dir)).select(F.posexplode("weights").alias("i", "w"))
    return weights.select(F.get(names, F.col("i")).alias("expert"), rounded(F.col("w"), 6).alias("weight"))


@query()
def pca_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two principal components of every frame, over all frames."""
    return pca.principal_axes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "pca")


@query()
def mlp_pool_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing probabilities of pooled frames under seeded weights."""
    pooled = segments.pooled(adapters.segments(spark, sf_dir), "clip_id")
    return pooled.select("clip_id", router.route(spark, F.col("pooled"), router.Weights.seeded(64, 32, len(EXPERTS))).alias("probs"))


@query()
def synthetic_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated clips, one for each supplier, with noisy scores and frames."""
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip_id"))
    noisy = synthetic.with_noise(synthetic.clips(ids, 4, 32), "clip_id", SEED, 0.05)
    return synthetic.with_frames(noisy, regimes=4, length=32)
