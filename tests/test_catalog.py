"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from tamiz.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    assert len(cols) == len(set(cols))
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == Counter(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
