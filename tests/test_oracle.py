"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from routeloom import oracle, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module", autouse=True)
def one_analysis(spark):
    """All queries share one analysis, whose frames are kept."""
    make, shared = queries._analysis, {}
    queries._analysis = lambda s, d: shared.setdefault(d, make(s, d))
    yield
    queries._analysis = make
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, str(DATA))
    got = _rows(df.columns, df.collect())
    rel = con.execute(oracle.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == _rows(columns, rel.fetchall())
