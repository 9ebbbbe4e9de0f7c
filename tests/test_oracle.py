"""Every registered query with a DuckDB oracle must match it (sf0.001)."""
import datetime as dt
import decimal
import math

import duckdb
import numpy as np
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from quarry.sources.tables import TABLES

ORACLES = E.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, (float, np.floating)):
        f = float(v)
        if math.isnan(f):
            return None
        r = round(f, 5)
        return 0.0 if r == 0 else r
    if isinstance(v, (bool, np.bool_)):
        return int(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr), \
        [cols[i] for i in order]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    a, ac = _rows(sdf.columns, [tuple(r) for r in sdf.collect()])
    cur = duck.execute(ORACLES[name])
    b, bc = _rows([d[0] for d in cur.description], cur.fetchall())
    assert ac == bc
    assert len(a) == len(b)
    assert a == b


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "event_flag" in df.columns
