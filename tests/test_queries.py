"""Every registered query against its DuckDB oracle on the smallest driver tables (the driver's check)."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from geoweave.plans.tables import TABLES
from tests.conftest import SF_SMALL

ORACLES = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    want = cur.fetchall()
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
    assert Counter(tuple(_norm(r[i]) for i in order) for r in got) == \
        Counter(tuple(_norm(r[i]) for i in oorder) for r in want)
