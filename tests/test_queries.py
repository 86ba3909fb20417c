"""Every registered query against its SQL at the smallest scale, and without the optional subpackage."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CORE = [k for k in entry.core.oracle_sql() if os.path.exists(FOLDER)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return "NULL" if v is None else str(v)


def compare(spark, duck, queries, sql, name):
    df = queries[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = duck.sql(sql[name])
    assert sorted(rel.columns) == names
    want = sorted(tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", CORE)
def test_like_sql(spark, duck, name):
    compare(spark, duck, entry.core.queries(), entry.core.oracle_sql(), name)


@pytest.mark.parametrize("name", sorted(set(entry.core.queries()) - set(CORE)) if CORE else [])
def test_runs(spark, name):
    assert entry.core.queries()[name](spark, FOLDER).count() > 0


@pytest.mark.skipif(not CORE, reason="no test data")
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["scaled_jsd"] is None or 0 <= r["scaled_jsd"] <= 1 for r in rows)
