"""Every registered query of the library against its SQL in DuckDB, and the others for their shape."""

import math
import os

import pytest

from marlstone.plans import catalog

SF = "/root/testdata/sf0.001"
Q, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = Q[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(norm(v) for v in r) for r in want.select(*columns).fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert Q[name](spark, SF).count() > 0
