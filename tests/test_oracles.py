"""Every library query that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from deviatix.plans import library

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return (2, round(float(v), 6) + 0.0)
    return (3, str(v))


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query(spark, duck, name):
    got = library.QUERIES[name](spark, DATA)
    want = duck.sql(library.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(cell(v) for v in r) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for (k, u), (m, v) in zip(x, y, strict=True):
            assert k == m
            assert u == pytest.approx(v, rel=1e-9, abs=1.5e-6) if k == 2 else u == v


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_runs(spark, name):
    assert library.QUERIES[name](spark, DATA).count() > 0
