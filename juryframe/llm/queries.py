"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from juryframe.llm import edit_embedding, kneser_ney, mixing, odd_sketch, packing, periodic, prefix_trie, quality_rules, secrets, simhash, token_counts, url_filter, warc
from juryframe.llm.common import WORD, table
from juryframe.llm.sql import odd_sketch_sql, prefix_trie_sql, quality_sql, url_sql, warc_sql


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"),
        F.col("mix_copies").alias("copies"),
        F.col("mix_rate").alias("rate"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Rules of op6_url_filter.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No label is about a page, so pages are their own outcomes.
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.judge_urls(pages, url_filter.junk_outcomes(pages), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.edit_fingerprints(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.fresh_path(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _repeating(doc_id: Column, text: Column) -> Column:
    """``text``, whose words go round from a place on where the hash of the id is a multiple of ten; without an id it stays."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def made(words: Column) -> Column:
        a = F.pmod(g, F.size(words))
        p = 1 + F.floor((F.size(words) - a) / (3 + F.pmod(g, F.lit(8))))
        # Both are worked out once a text, as members of an array of one.
        return F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.array_join(F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")))), " "))[0]

    edited = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda words: F.when(F.size(words) > 0, made(words)).otherwise(""))[0]
    return F.when(h % 10 == 0, edited).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _repeating(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.with_digests(periodic.periodic_runs(docs))


def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture": op1_mixture,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_edit_fingerprints": op7_edit_fingerprints,
    "op8_secret_scan": op8_secret_scan,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_odd_sketches": op12_odd_sketches,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Twins where SQL can express the query; the others are tested against brute force.
SQL: dict[str, str] = {"op4_quality_rules": quality_sql(), "op6_url_filter": url_sql(URL_RULES), "op10_warc": warc_sql(), "op12_odd_sketches": odd_sketch_sql(), "op13_prefix_trie": prefix_trie_sql()}
