"""Every query with oracle SQL against an independent engine, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry
from plumbline.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in registry.ORACLE_SQL if n in entry.queries())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(records, columns):
    places = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in places) for r in records), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    there = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(there.columns)
    assert rows(df.collect(), df.columns) == rows(there.fetchall(), list(there.columns))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "auc", "n_pos", "n_neg"]
