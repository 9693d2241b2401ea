"""Queries over files: footers, copies in small row groups, access by key and by place, half-precision numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juryframe.plans.registered import query
from juryframe.sources import halves, places, row_groups
from juryframe.sources.adapters import table

#: Tables whose footers are read.
FOOTED = ("lineitem", "orders", "documents", "embeddings", "events", "conversations", "pages")
#: Keys and places that are looked up.
KEYS, PLACES = (3, 77, 1009), (0, 1, 1499)


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in FOOTED))
def footer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table, from footers alone."""
    parts = [row_groups.footers(spark, f"{sf_dir}/{t}.parquet").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).select(F.lit(t).alias("name"), "rows") for t in FOOTED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("SELECT count(*) > 0 AS small, count(*) AS rows, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem")
def small_group_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of a table in small row groups: whether they are, its rows and a sum over them."""
    copy = row_groups.ensure_small_groups(spark, f"{sf_dir}/lineitem.parquet", f"{places.shared_dir(spark)}/small-groups")
    small = row_groups.footers(spark, copy).agg((F.max("rows") <= row_groups.RECHUNK_ABOVE).alias("small"))  # one row
    sums = spark.read.parquet(copy).agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").cast("long").alias("quantity"))
    return small.join(F.broadcast(sums), how="cross")


def _clustered(spark: SparkSession, sf_dir: str) -> str:
    """A copy of orders laid out by key, made anew where the table is newer."""
    source = f"{sf_dir}/orders.parquet"
    target = row_groups.cache_path(source, f"{places.shared_dir(spark)}/clustered", row_groups.PAGE_ROWS)
    newest = row_groups.files(spark, source).agg(F.max(F.unix_millis("modified"))).first()[0]
    if places.modified(spark, f"{target}/_SUCCESS") < newest:
        row_groups.write_clustered(table(spark, sf_dir, "orders"), target, "o_orderkey", mode="overwrite")
    return target


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN {KEYS}")
def point_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few rows by their keys, from a table that is laid out for it."""
    return row_groups.rows_of(spark, _clustered(spark, sf_dir), "o_orderkey", KEYS, ["o_orderkey", "o_custkey", "o_orderstatus"])


@query(f"SELECT CAST(i AS BIGINT) AS index, CAST(i AS BIGINT) AS place FROM (VALUES {', '.join(f'({i})' for i in PLACES)}) t(i) WHERE i < (SELECT count(*) FROM orders)")
def row_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where rows of a table lie, by their numbers: their group's start and place make the number again."""
    groups = row_groups.group_starts(spark, f"{sf_dir}/orders.parquet")
    found = [row_groups.locate(groups, i).join(groups.select("file", "group", "start"), ["file", "group"]).select(F.lit(i).cast("long").alias("index"), (F.col("start") + F.col("place")).alias("place")) for i in PLACES]
    return found[0].unionByName(found[1]).unionByName(found[2])


_SIZE = "abs(CAST(x AS DOUBLE))"
_STEP = f"CASE WHEN {_SIZE} < pow(2.0::DOUBLE, -14) THEN pow(2.0::DOUBLE, -24) ELSE pow(2.0::DOUBLE, floor(log2({_SIZE})) - 10) END"


@query(f"""WITH numbers AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS d FROM embeddings),
halves AS (SELECT vec_id, CAST(d AS INTEGER) AS d, CASE WHEN {_SIZE} = 0 THEN 0.0 ELSE round_even(CAST(x AS DOUBLE) / ({_STEP}), 0) * ({_STEP}) END AS half FROM numbers),
powers AS (SELECT *, floor(log2(CASE WHEN half = 0 THEN 1 ELSE abs(half) END) + 1e-6) AS p FROM halves)
SELECT vec_id, d, half + 0.0 AS half, CAST(CASE WHEN half < 0 THEN 32768 ELSE 0 END + CASE WHEN abs(half) < pow(2.0::DOUBLE, -14) THEN abs(half) * pow(2.0::DOUBLE, 24)
  ELSE (p + 15) * 1024 + abs(half) * pow(2.0::DOUBLE, 10 - p) - 1024 END AS INTEGER) AS bits FROM powers""")
def half_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of the embeddings as half-precision: written as two bytes, read again and decoded, and its bits."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", halves.encode_half(F.array("embedding")).alias("stored"))
    decoded = vectors.select("vec_id", "stored", halves.decode_half(F.col("stored")).alias("frames"))
    rows = decoded.select("vec_id", F.posexplode(F.arrays_zip(F.col("frames")[0].alias("half"), F.col("stored")[0].alias("two"))).alias("d", "n"))
    return rows.select("vec_id", "d", (F.col("n.half").cast("double") + 0.0).alias("half"), halves.bits_of(F.col("n.two")).alias("bits"))
