"""Every query against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quarrywork.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    answer = duck.sql(ORACLE_SQL[name])
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in places)) for r in answer.fetchall())
