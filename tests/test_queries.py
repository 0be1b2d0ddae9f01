"""Every query with SQL gives the rows that another engine gives for it."""

import glob
import os

import duckdb
import pytest

from tessera.plans.more import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, other, name):
    mine = QUERIES[name](spark, SF)
    theirs = other.sql(ORACLE_SQL[name])
    columns = sorted(mine.columns)
    assert sorted(theirs.columns) == columns
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    a = sorted(repr([plain(r[c]) for c in columns]) for r in mine.collect())
    at = [theirs.columns.index(c) for c in columns]
    assert a == sorted(repr([plain(r[i]) for i in at]) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
