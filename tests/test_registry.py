"""Every query with SQL against the same SQL in DuckDB, on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

from tracegrid.plans import registry

DATA = os.environ.get("TRACEGRID_TESTDATA", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


def test_every_query_has_a_function():
    assert set(SQL) <= set(registry.queries()) and len(registry.queries()) > 130


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    """NULL, NaN, truth and numbers are told apart; sums may differ in the order of their terms only."""
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float) and v != v:
        return "NaN"
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return v if isinstance(v, int) else float(f"{float(v):.12g}")
    return v


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def equal(a, b):
    """Row by row: floats to twelve digits or a billionth, everything else exactly."""
    if len(a) != len(b):
        return False
    near = lambda x, y: x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool) and not isinstance(y, bool) and (isinstance(x, float) or isinstance(y, float)) and abs(x - y) <= 1e-9 + 1e-11 * abs(x))
    return all(len(r) == len(s) and all(near(x, y) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    a, b = sorted_rows(df.columns, df.collect()), sorted_rows(names, cur.fetchall())
    assert equal(a, b), next(((x, y) for x, y in zip(a, b, strict=False) if x != y), (len(a), len(b)))
