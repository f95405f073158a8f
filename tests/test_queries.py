"""Every query with an SQL twin gives the twin's rows."""

import datetime
import math

import duckdb
import pytest

from assayline.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    if isinstance(v, datetime.datetime):
        return v.date()
    return int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    cols = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    b = sorted((tuple(plain(v) for _, v in sorted(zip(names, r))) for r in want.fetchall()), key=str)
    assert a == b
