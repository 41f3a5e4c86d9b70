"""Queries of the training-data operators against their SQL."""

import os

import duckdb
import pytest

from hunkwise.llm import queries, sql

SF = "/root/testdata/sf0.01"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query(shipped, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    got = queries.QUERIES[name](shipped, SF)
    cols = sorted(got.columns)
    found = c.sql(sql.ORACLES[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(x) for x in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert want == sorted((tuple(map(plain, r)) for r in got.select(*cols).collect()), key=repr)
