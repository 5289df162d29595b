"""Queries that must cover their whole tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from opweave.plans import doclog

SF = Path("/root/testdata/sf0.001")


def test_merged_replicas_hold_every_change(spark):
    if not SF.exists():
        pytest.skip("no test tables")
    every = {(r.doc_id, r.hash) for r in doclog.changes(spark, str(SF)).select("doc_id", "hash").collect()}
    merged = [(r.doc_id, r.hash) for r in entry.queries()["merge_histories"](spark, str(SF)).collect()]
    assert len(merged) == len(every) and set(merged) == every
    stopped = {(r.doc_id, r.hash) for r in doclog.replica_then(doclog.changes(spark, str(SF))).select("doc_id", "hash").collect()}
    added = {(r.doc_id, r.hash) for r in entry.queries()["graph_changes_added"](spark, str(SF)).collect()}
    assert stopped and added == every - stopped
