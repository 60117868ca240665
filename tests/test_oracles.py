"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
import os

import duckdb
import pytest

from sparkloom.plans import content_queries, reader_queries, relational, study_queries
from sparkloom.session import TABLES
from sparkloom.streaming import events

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ALL = {n: (f, m.ORACLES.get(n)) for m in (relational, study_queries, content_queries, reader_queries, events) for n, f in m.QUERIES.items()}


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)) if not isinstance(x, int | float) else "", x if x is not None else 0) for x in r])


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ALL)
def test_query(spark, db, name):
    f, sql = ALL[name]
    df = f(spark, DATA)
    columns = sorted(df.columns)
    rows = in_order([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    assert sql, "every query here has SQL"
    want = db.sql(sql)
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert rows == in_order([tuple(plain(r[i]) for i in at) for r in want.fetchall()])
