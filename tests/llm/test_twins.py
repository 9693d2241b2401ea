"""The queries that SQL can express agree with DuckDB."""

import pytest

from juryframe.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "documents", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    twin = con.sql(SQL[name])
    assert sorted(twin.columns) == sorted(df.columns)
    columns = ", ".join(sorted(df.columns))
    ours = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    assert ours == sorted(con.sql(f"select {columns} from ({SQL[name]})").fetchall(), key=str)
