"""Every query of the subpackage runs on the smallest tables; with SQL, it gives the SQL's rows."""

import glob
import os

import duckdb
import pytest

from evidencia.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {"p1_found": ["dup_id_a", "dup_id_b"], "p2_found": ["page_id", "pii_type", "pii_value"], "p3_found": ["page_id", "para_no", "lang"], "p4_found": ["page_id", "line_no"], "p5_found": ["page_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows
    if name in COLUMNS:
        assert len(set(rows)) == len(rows)
    if name in queries.ORACLE:
        con = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        assert sorted(rows) == sorted(tuple(map(str, r)) for r in con.execute(queries.ORACLE[name]).fetchall())
