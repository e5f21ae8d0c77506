"""The registered queries on the smallest tables, and those with SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

from tamiz.llm import queries as Q

QUERIES, SQL = Q.queries(), Q.oracle_sql()
COLUMNS = {"p1_found": ["texto_id"], "p2_found": ["tramo_id"], "p3_found": ["doc_id_a", "doc_id_b"], "p4_found": ["texto_id", "campo"], "p5_found": ["texto_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "inicio", "fin"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows)
    if name in SQL:
        c = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        r = c.execute(SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(map(tuple, rows)) == sorted(tuple(x[names.index(k)] for k in df.columns) for x in r.fetchall())
