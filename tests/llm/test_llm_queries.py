"""Every query of the subpackage that has SQL against DuckDB, over whole tables of the smallest scale."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from talweg.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def database(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, sf, database, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = database.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(row[i]) for i in order) for row in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == theirs
