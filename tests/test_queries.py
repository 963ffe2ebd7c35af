"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tidelog.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = db.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall())
    assert mine == theirs


def test_filters_and_columns_reach_the_scan(spark):
    from tidelog.operators.scan import blocks
    from tidelog.queries import log_of

    plan = blocks(log_of(spark, DATA), 20).select("key")._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in plan and "ReadSchema: struct<user_id:bigint,event_type:string>" in plan.replace("event_type:string,user_id:bigint", "user_id:bigint,event_type:string")
