"""Queries for synchronisation and for the binary and JSON forms of whole logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, sync
from ..sources import chunks, interchange
from .doclog import _HIST, changes, middle_version, ops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _whole(spark, d):
    """Changes with their operations, as far as these were delivered completely."""
    return chunks.nested(changes(spark, d), ops(spark, d)).where(F.size("ops") == F.col("num_ops"))


def sync_filters(spark: SparkSession, d: str) -> DataFrame:
    c = changes(spark, d)
    return sync.make_filters(c, middle_version(c)).select("doc_id", "n_hashes", F.octet_length("bloom").alias("n_bytes"))


def sync_to_send(spark: SparkSession, d: str) -> DataFrame:
    """What a peer that holds half of each history lacks, by its filter."""
    c = changes(spark, d)
    theirs = graph.ancestors(c, middle_version(c))
    return sync.hashes_to_send(c, sync.make_filters(theirs))


def binary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document written as one chunk and read again: changes, operations and hashes that came back."""
    written = chunks.document_bytes(_whole(spark, d))

    def read(batches):
        import pandas as pd

        for b in batches:
            got = [chunks.count(x) for x in b["bytes"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_written": b["n_changes"], "n_read": [n for n, _ in got], "n_ops": [n for _, n in got], "n_bytes": [len(x) for x in b["bytes"]]})

    return written.mapInPandas(read, "doc_id bigint, n_written int, n_read int, n_ops bigint, n_bytes bigint")


def binary_change_sizes(spark: SparkSession, d: str) -> DataFrame:
    return chunks.change_bytes(_whole(spark, d)).select("doc_id", "stored_hash", "hash", "n_bytes")


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every change written as JSON and read again: its operations as they came back."""
    back = interchange.from_json(interchange.to_json(_whole(spark, d)))
    _, o = chunks.tables(back)
    return o.select("doc_id", "change_hash", F.col("op.ctr").alias("ctr"), F.col("op.actor").alias("actor"), "op_key", "is_insert", F.col("op_action").cast("int").alias("op_action"),
                    F.col("val.tag").alias("tag"), F.col("val.i").alias("i"), F.col("val.s").alias("s"), F.size("pred").alias("n_pred"))


def json_changes(spark: SparkSession, d: str) -> DataFrame:
    return interchange.summary(changes(spark, d))


QUERIES |= {f.__name__: f for f in (sync_filters, sync_to_send, binary_round_trip, binary_change_sizes, json_round_trip, json_changes)}
_COMPLETE = f"""{_HIST}, n AS (SELECT doc_id, change_hash AS hash, count(DISTINCT op) AS n FROM ops GROUP BY ALL),
w AS (SELECT c.* FROM c JOIN n USING (doc_id, hash) WHERE n = num_ops)"""
ORACLES |= {
    "sync_filters": f"""{_HIST} SELECT doc_id, count(*) AS n_hashes, (1 + CASE WHEN count(*) > 16383 THEN 3 WHEN count(*) > 127 THEN 2 ELSE 1 END + 1 + (count(*) * 10 + 7) // 8)::INT AS n_bytes
FROM c WHERE NOT EXISTS (SELECT 1 FROM anc WHERE (anc.doc_id, anc.hash) = (c.doc_id, c.hash)) GROUP BY ALL""",
    "json_round_trip": f"""{_COMPLETE}
SELECT DISTINCT ops.doc_id, change_hash, op.ctr AS ctr, op.actor AS actor, op_key, is_insert, op_action::INT AS op_action, val.tag AS tag, val.i AS i, val.s AS s, len(pred)::INT AS n_pred
FROM ops JOIN w ON w.doc_id = ops.doc_id AND w.hash = ops.change_hash""",
}
