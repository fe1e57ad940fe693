"""Every query with SQL gives the rows that DuckDB gives on the same tables; every query runs."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_same_as_sql(spark, data, duck, name):
    df = entry_point.queries()[name](spark, data)
    names = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = duck.sql(entry_point.oracle_sql()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert found == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql())))
def test_runs(spark, data, name):
    df = entry_point.queries()[name](spark, data)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.count()


def test_entry(spark):
    assert entry_point.entry(spark).count() >= 0
