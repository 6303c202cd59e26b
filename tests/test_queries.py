"""Every registered query against its SQL, on the smallest data."""

import glob
import math
import os
from collections import Counter

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from pageloom.plans import CATALOGS

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, list) else value


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(name for catalog in CATALOGS for name in catalog.queries))
def test_query(spark, db, name):
    df = queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert as_rows(df.columns, got) == as_rows(names, want)
