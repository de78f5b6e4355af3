"""Every registered query against its SQL in DuckDB, on the smallest test tables."""

import math
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from assayline.workload import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(names, records):
    order = sorted(names)
    at = [names.index(n) for n in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, str(FOLDER))
    want = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["user_id", "incidents", "events", "total"] and df.count() > 0
