"""The contract of the entry module: every query runs, and equals its SQL where it has one."""

import os

import duckdb
import pytest

import __spark_entry__ as e
from hunkwise.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*cols).collect()), key=repr)
    sql = catalog.ORACLES.get(name)
    if sql is None:
        assert rows
        return
    found = tables.sql(sql)
    at = [found.columns.index(c) for c in cols]
    assert sorted(found.columns) == cols
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
