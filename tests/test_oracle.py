"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

from quantloom.plans import catalog

SF = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(round(x, 4) if isinstance(x, float) else x)) for x in r))
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(order(got), order(want)) for x, y in zip(a, b))
