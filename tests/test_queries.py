"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from scripts.verify import canonical

SF = Path("/root/testdata/sf0.001")
SOME = (
    "p1_found p1_actor_profile p2_found p2_distinct_changes p3_found p3_entries_with_base p5_found p6_sessions p7_found "
    "graph_heads graph_stats graph_op_changes state_get state_conflicts state_counters seq_order text_content diff_registers merge_logs"
).split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not SF.exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    got = canonical(entry.queries()[name](spark, str(SF)).toArrow())
    want = canonical(con.sql(entry.oracle_sql()[name]).to_arrow_table())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in (1, 2, 3, 5, 6, 7):
        assert any(q.startswith(f"p{n}_") for q in entry.queries())


def test_entry(spark):
    if not SF.exists():
        pytest.skip("no test tables")
    assert entry.entry(spark).columns == ["doc_id", "obj_id", "op_key", "op_id"]
