"""Queries that put tables, texts and settings together, and take sequences apart and together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juryframe.functions import text
from juryframe.operators import combine, segments, split
from juryframe.plans.fragments import FRAMES, SCORES, SPLIT
from juryframe.plans.registered import query, r
from juryframe.schema import rounded
from juryframe.sources import adapters, clip_files
from juryframe.sources.adapters import table


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000")
def sql_over_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip_files.scan_sql(spark, f"{sf_dir}/orders.parquet", "o_orderkey, o_orderstatus, o_totalprice", "o_totalprice > 100000")


@query(f"WITH {SCORES} SELECT * FROM scores")
def prefixed_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of single experts with generic columns, named by alias, put together."""
    scores = adapters.scores(spark, sf_dir)
    own = {a: scores.select("clip_id", F.col(f"{e}_wer").alias("wer")) for a, e in (("hubert", "hubert"), ("whisper", "whisper"), ("wav2vec2", "w2v2"))}
    return combine.assemble({a: combine.prefixed(df, a) for a, df in own.items()}, "clip_id")


@query(f"WITH {SCORES} SELECT clip_id, 'first' AS ground_truth, hubert_wer, whisper_wer FROM scores")
def keep_first_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of columns that both tables have, those of the first stay."""
    scores = adapters.scores(spark, sf_dir)
    first = scores.select("clip_id", F.lit("first").alias("ground_truth"), "hubert_wer")
    return combine.assemble_keeping_first([first, scores.select("clip_id", F.lit("second").alias("ground_truth"), "whisper_wer")], "clip_id")


@query("""SELECT p_partkey, 'brand' AS name, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part
UNION ALL SELECT p_partkey, 'type', p_type FROM part""")
def overridden_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a variant over those that all share."""
    shared = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.lit("0"))
    own = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(combine.override(shared, own)).alias("name", "value"))


@query(f"WITH {SPLIT} SELECT clip_id, label FROM split WHERE split = 'val'")
def selected_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from juryframe.functions.choice import argmin
    from juryframe.schema import score_array

    return split.select_split(adapters.split_scores(spark, sf_dir), "val").select("clip_id", argmin(score_array()).alias("label"))


@query(r"""SELECT conv_id * 1000 + turn AS clip_id, trim(coalesce(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''), ' '), '')) AS joined FROM conversations""")
def joined_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("clip_id"), text.join_tokens(text.tokens(F.col("text"))).alias("joined"))


def _long_words(least: int) -> str:
    return f"len(list_filter(string_split(text, ' '), lambda x: length(x) >= {least}))"


#: Least characters of a reference's words and of a hypothesis's, which leaves some of both without words.
REF_WORD, HYP_WORD = 11, 12
_RATE = "CASE WHEN {empty} ELSE (n_ref - n_hyp) / CAST(n_ref AS DOUBLE) END"
_POLICY_SQL = {
    "score": "n_ref = 0 THEN 0.0::DOUBLE",
    "rover": "n_ref = 0 THEN CASE WHEN n_hyp = 0 THEN 0.0::DOUBLE ELSE 1.0 END",
    "strict": "n_ref = 0 OR n_hyp = 0 THEN 1.0::DOUBLE",
    "equal": "n_ref = 0 OR n_hyp = 0 THEN CASE WHEN n_ref = n_hyp THEN 0.0::DOUBLE ELSE 1.0 END",
}


@query(f"""WITH sized AS (SELECT item_id, {_long_words(REF_WORD)} AS n_ref, {_long_words(HYP_WORD)} AS n_hyp FROM benchmark)
SELECT item_id, CAST(n_ref AS INTEGER) AS n_ref, CAST(n_hyp AS INTEGER) AS n_hyp, {", ".join(f"{r(_RATE.format(empty=e))} AS {p}" for p, e in _POLICY_SQL.items())} FROM sized""")
def word_error_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four ways to rate empty texts. Hypotheses leave out words of the references, so the twin's distance is a difference."""
    words = lambda least: F.filter(F.split("text", " "), lambda x: F.length(x) >= least)
    rows = table(spark, sf_dir, "benchmark").select("item_id", words(REF_WORD).alias("ref"), words(HYP_WORD).alias("hyp"))
    sized = rows.select("item_id", F.size("ref").alias("n_ref"), F.size("hyp").alias("n_hyp"), text.word_distance(F.col("ref"), F.col("hyp")).alias("edits"))
    rates = [rounded(text.word_error_rate(F.col("edits"), F.col("n_ref"), F.col("n_hyp"), p), 6).alias(p) for p in text.POLICIES]
    return sized.select("item_id", "n_ref", "n_hyp", *rates)


@query("SELECT conv_id * 1000 + turn AS clip_id FROM conversations WHERE len(string_split(text, ' ')) > 100")
def long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with more than a number of samples, which are words here."""
    rows = table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("clip_id"), F.struct(F.split("text", " ").alias("array")).alias("audio"))
    return clip_files.long_audio(clip_files.some_audio(rows), least=100).select("clip_id")


@query("SELECT p_partkey, CAST(3 AS INTEGER) AS n, CAST(p_size + p_partkey % 7 - 5 AS BIGINT) AS total FROM part")
def int_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma lists of integers with blanks in between."""
    listed = F.concat(F.col("p_size"), F.lit(" , ,"), F.col("p_partkey") % 7, F.lit(",, -5"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.int_list(listed).alias("v"))
    return rows.select("p_partkey", F.size("v").alias("n"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


TOTAL = r("list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))", 4)


def _totals(parts: DataFrame) -> DataFrame:
    rows = parts.select("clip_id", "start", F.posexplode("frames").alias("t", "frame"))
    return rows.select("clip_id", (F.col("start") + F.col("t")).alias("t"), rounded(F.aggregate("frame", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query(f"WITH {FRAMES} SELECT clip_id, t, {TOTAL} AS total FROM frames WHERE t < 12 + 3 * clip_id")
def trimmed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences without their padding, each by its own valid length."""
    return _totals(segments.trim(adapters.segments(spark, sf_dir), 12 + 3 * F.col("clip_id")))


@query(f"WITH {FRAMES} SELECT clip_id, t, {TOTAL} AS total FROM frames")
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences taken apart into single values by position, and built again from values and lengths."""
    parts = adapters.segments(spark, sf_dir)
    return _totals(segments.nested(segments.flat_values(parts, "clip_id", 64), segments.lengths(parts, "clip_id"), "clip_id", 64))
