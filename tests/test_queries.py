from __future__ import annotations

import glob
import os

import duckdb
import pytest

from segloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


def plain(value):
    if hasattr(value, "as_tuple") or isinstance(value, (float, int)) and not isinstance(value, bool):
        return round(float(value), 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rows = got.collect()
    assert rows
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == sorted(got.columns)
        order = sorted(got.columns)
        ours = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
        theirs = sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=str)
        assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
