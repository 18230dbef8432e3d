"""Every query with SQL against DuckDB, on the smallest tables; the others give rows."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

from tideline.plans import reference

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def value(x):
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 5) + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5)


@pytest.mark.parametrize("name", sorted(reference.queries()))
def test_query(spark, duck, name):
    frame = reference.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    rows = sorted(([value(r[c]) for c in columns] for r in frame.collect()), key=repr)
    assert rows
    if name in reference.oracle_sql():
        found = duck.sql(reference.oracle_sql()[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        other = sorted(([value(r[i]) for i in at] for r in found.fetchall()), key=repr)
        assert len(rows) == len(other)
        assert all(same(x, y) for a, b in zip(rows, other) for x, y in zip(a, b))
