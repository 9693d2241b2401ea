"""Every query with a twin agrees with DuckDB on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from juryframe.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
            return None
        if isinstance(x, str):
            return x
        return round(float(x), 9) if isinstance(x, float) else int(x)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(value(x) for x in row) for row in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, sf_dir, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["oracle_model", "count", "percentage"]
    assert sum(r["count"] for r in found.collect()) == 5999


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_reads_only_scores(spark, sf_dir):
    from juryframe.sources import adapters

    plan = adapters.scores(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
