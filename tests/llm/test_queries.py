"""Queries with SQL against DuckDB on a small table."""

from collections import Counter

import duckdb
import pytest

from seqwarden.llm.catalog import llm_queries

SMALL = "/root/testdata/sf0.001"
WITH_SQL = {q.name: q for q in llm_queries() if q.oracle}


@pytest.mark.parametrize("name", WITH_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    result = con.execute(WITH_SQL[name].oracle)
    names = [c[0] for c in result.description]
    df = WITH_SQL[name].run(spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(result.fetchall())
