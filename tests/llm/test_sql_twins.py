"""Queries with an SQL twin agree with it, on odd rows and on the given tables."""

import duckdb
import pytest
from corpus import rows, sf_small  # noqa: F401

from flowhelm.llm import queries


def both(spark, folder, name):
    frame = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    key = lambda row: tuple(str(x) for x in row)
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=key), sorted(cur.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, sf_small, sf, name):
    for folder in (sf_small, sf):
        got, want = both(spark, folder, name)
        assert got == want
