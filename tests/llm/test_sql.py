"""Training-data queries that SQL can express give the rows that DuckDB gives."""

import duckdb
import pytest

from helixframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    rows = lambda columns, data: sorted((tuple(r[columns.index(c)] for c in names) for r in data), key=lambda r: tuple(map(str, r)))
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
