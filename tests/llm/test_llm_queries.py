"""Every query with SQL against DuckDB."""

import os

import duckdb
import pytest

from answergrid.llm import QUERIES

SF = os.environ.get("TEST_QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name].run(spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(r[c] for c in columns) for r in df.collect())
    result = con.execute(QUERIES[name].sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == ordered(tuple(row[names.index(c)] for c in columns) for row in result.fetchall())
    assert got
