"""Queries with SQL, against it, on the smallest test tables."""

from __future__ import annotations

import duckdb
import pytest

from turnwake.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    names = sorted(rel.columns)
    want = sorted(tuple(str(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())
    df = queries.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == names
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == want
