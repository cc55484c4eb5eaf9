"""Every query with SQL gives the rows of that SQL; every query without gives a stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    return x


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect()]
    assert len(set(columns)) == len(columns)
    if (sql := entry.oracle_sql().get(name)) is None:
        return
    found = db.sql(sql)
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    assert rows or name in {"none"}, "no row to compare"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
