"""Every registered query that has SQL equals DuckDB over the smallest tables; the others run."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from gristmill.plans.every import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return ""
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        v = float(v)
        return str(int(v)) if v == v and v == int(v) else f"{v:.6g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
