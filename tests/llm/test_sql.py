"""The queries that SQL can state, against DuckDB on the smallest tables."""

import duckdb
import pytest

from palimpsest.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, DIR), con.sql(registry.SQL[name])
    cols = sorted(want.columns)
    assert cols == sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
