"""Every registered query against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "part benchmark documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.core_queries()))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    expected = duck.sql(entry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    rows = Counter(tuple(r[c] for c in columns) for r in found.collect())
    places = [expected.columns.index(c) for c in columns]
    assert rows == Counter(tuple(r[i] for i in places) for r in expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
