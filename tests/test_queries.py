"""Every registered query against its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from answergrid.plans import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SF = os.environ.get("TEST_QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(r[c] for c in columns) for r in df.collect())
    result = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = ordered(tuple(row[i] for i in places) for row in result.fetchall())
    assert got == expected
    assert got


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns[:2] == ["conv_id", "turn"]
    assert df.count() > 0
