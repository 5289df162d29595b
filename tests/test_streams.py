"""Streams of deliveries: once each, in causal order, and folded as they come."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from opweave.operators import feed
from opweave.streaming import deliveries
from tests.test_log_operators import CHANGES, OPS, op

ROWS = [
    (1, 1, "b", "x", 2, ["a"]), (2, 1, "d", "y", 1, ["b", "c"]), (3, 2, "q", "x", 1, ["never"]), (4, 1, "c", "x", 3, ["b"]),
    (5, 1, "B ", "x", 2, ["a"]), (6, 1, "a", "x", 1, []), (7, 1, "a", "x", 1, []), (8, 1, None, "z", 1, None), (9, 2, "r", "x", 2, []),
]


def _files(spark, path, rows, schema):
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    return f"{path}/*"


def _run(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return stream.sparkSession.table(name).collect()


def _changes(rows):
    return [(i, d, h, a, s, s, s, None, None, deps) for i, d, h, a, s, deps in rows]


def test_causal_order_and_copies(spark, tmp_path):
    schema = spark.createDataFrame([], CHANGES).schema
    path = _files(spark, tmp_path / "in", _changes(ROWS), schema)
    rows = _run(deliveries.causal_stream(deliveries.read_deliveries(spark, path, schema, 3)), tmp_path, "causal")
    order = [r.hash for r in rows if r.doc_id == 1]
    assert sorted(order) == ["a", "b", "c", "d"]
    for before, after in (("a", "b"), ("b", "c"), ("b", "d"), ("c", "d")):
        assert order.index(before) < order.index(after)
    assert [(r.hash, r.held) for r in rows if r.doc_id == 2] == [("r", False)]


def test_distinct_stream(spark, tmp_path):
    schema = spark.createDataFrame([], CHANGES).schema
    path = _files(spark, tmp_path / "in", _changes(ROWS), schema)
    rows = _run(deliveries.distinct_deliveries(deliveries.read_deliveries(spark, path, schema, 4)), tmp_path, "once")
    assert sorted((r.hash or "") for r in rows) == ["", "a", "b", "c", "d", "q", "r"]


def test_folding_a_stream_equals_the_batch(spark, tmp_path):
    r = random.Random(5)
    rows = [op(c, 1, c, r.choice("ab"), action=r.choice([1, 1, 3]), key=r.choice("kl"), pred=[(r.randint(1, c), r.choice("ab"))]) for c in range(1, 13)]
    rows += rows[3:6]
    r.shuffle(rows)
    schema = spark.createDataFrame([], OPS).schema
    path = _files(spark, tmp_path / "in", rows, schema)
    stream = deliveries.read_deliveries(spark, path, schema, 6)
    deliveries.current_entries_table(stream, f"{tmp_path}/table", f"{tmp_path}/cp").awaitTermination(180)
    last = sorted(p.name for p in (tmp_path / "table").iterdir())[-1]
    got = feed.live_ops(spark.read.parquet(f"{tmp_path}/table/{last}"))
    want = feed.live_ops(feed.fold_ops(feed.op_facts(spark.createDataFrame(rows, OPS))))
    key = [F.col("ctr"), F.col("actor")]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_copies_without_hashes_and_with_null_parts(spark, tmp_path):
    rows = [
        (1, 1, None, "a", 1, []), (2, 1, "H1 ", "a", 1, []), (3, 1, "h1", "a", 1, []), (4, 1, "h2", "a", 1, []), (5, 1, None, "a", 1, []),
        (6, 1, "h3", "b", 2, []), (7, 1, None, "b", 2, []), (8, None, "h3", "b", None, []),
        (9, 1, None, None, 5, []), (10, 1, None, "5", None, []), (11, 1, None, None, 5, []),
    ]
    schema = spark.createDataFrame([], CHANGES).schema
    path = _files(spark, tmp_path / "in", _changes(rows), schema)
    got = _run(deliveries.distinct_deliveries(deliveries.read_deliveries(spark, path, schema, 2)), tmp_path, "once")
    assert sorted(r.delivery_id for r in got) == [1, 4, 6, 9, 10, 11]
    assert {r.delivery_id: (r.hash, r.seq) for r in got}[4] == ("h2", 1)
