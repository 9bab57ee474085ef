"""Every query with SQL gives the SQL's rows on the smallest test tables."""

import glob
import os

import duckdb
import pytest

from evidencia.plans import catalog, claims, evidence  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = tables.execute(catalog.ORACLE[name])
    heads = [d[0] for d in cur.description]
    assert sorted(heads) == cols
    want = sorted(repr([plain(row[heads.index(c)]) for c in cols]) for row in cur.fetchall())
    assert got == want


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_no_nested_loops(spark):
    for name in ("mention_word_bounded", "crm_dedup_matched_by", "nearest_neighbor_event", "engine_attribution_exclusive", "claim_verdicts", "crm_new_channels", "naming_sources"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
