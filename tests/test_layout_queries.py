"""Layout queries on suppliers whose numbers lie next to a half, and on plans whose sizes nobody can guess."""

import os

import duckdb
import pytest

from assayline.plans import ORACLE_SQL, QUERIES
from tests.test_queries import plain


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Suppliers whose balance leaves 11.649999999999999 and its like where tenths are printed."""
    sf = tmp_path_factory.mktemp("halves")
    duckdb.sql(f"COPY (SELECT i::BIGINT AS s_suppkey, 'S' || i AS s_name, 0 AS s_nationkey, b::DOUBLE AS s_acctbal FROM (VALUES (1, -33.65), (2, 670.75), (3, 20.0)) t(i, b)) TO '{sf}/supplier.parquet' (FORMAT parquet)")
    return str(sf)


@pytest.mark.parametrize("name", ["cluster_rows_layout", "line_assembly", "outward_readout", "parse_layouts", "spatial_neighbourhood"])
def test_numbers_next_to_a_half_are_printed_as_in_the_sql(spark, halves, name):
    got = QUERIES[name](spark, halves)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{os.path.join(halves, 'supplier.parquet')}')")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = lambda all_: sorted((tuple(map(plain, r)) for r in all_), key=str)
    assert rows(tuple(r[c] for c in names) for r in got.collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", ["source_refs", "outward_readout", "spatial_neighbourhood"])
def test_items_of_a_page_are_not_broadcast(spark, name):
    """A supplier prints eighty items, which no estimate of its table's size knows of: a broadcast that it allows fills the driver."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert "SortMergeJoin" in plan


def test_only_the_registry_is_broadcast_to_a_parser(spark):
    """What rows are near to grows with the documents: it comes back to them by merging, and the driver holds fixed tables only."""
    plan = QUERIES["parse_layouts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, x in enumerate(plan) if "BroadcastExchange" in x]
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    for i in at:
        below = []
        for x in plan[i + 1:]:
            if depth(x) <= depth(plan[i]):
                break
            below.append(x)
        assert not any("FileScan" in x or "ReusedExchange" in x for x in below)
    assert sum("SortMergeJoin" in x for x in plan) == 2
