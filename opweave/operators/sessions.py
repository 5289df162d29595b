"""Sessions separated by pauses, built in time chunks and merged at their boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP_MS = 1_800_000
CHUNK_MS = 6 * 3_600_000


def sessions(events: DataFrame, key: str, time_ms: str, gap_ms: int = GAP_MS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """``key``, ``start_ms``, ``end_ms``, ``duration_ms``, ``n_events`` of each session.

    A pause of more than ``gap_ms`` starts a new session.  Events with a null key or a time that is
    null, zero or negative are left out; events at the same time belong together.

    1. Events are counted per (key, time): at most ``chunk_ms`` rows remain in a chunk, however hot.
    2. Local sessions are built in each (key, chunk).
    3. Only the first and last local session of a chunk can join a neighbour.  They alone are
       ordered per key, at most two for each chunk in which the key is active, and merged where the
       pause between them is short enough.
    """
    e = (
        events.select(F.col(key).alias("_k"), F.col(time_ms).cast("bigint").alias("_t"))
        .where(F.col("_k").isNotNull() & (F.col("_t") > 0))
        .groupBy("_k", "_t")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_chunk", F.expr(f"_t div {chunk_ms}"))
    )
    w = Window.partitionBy("_k", "_chunk").orderBy("_t")
    new = (F.col("_t") - F.lag("_t").over(w) > gap_ms).cast("int")
    local = (
        e.withColumn("_new", F.coalesce(new, F.lit(0)))
        .withColumn("_no", F.sum("_new").over(w))
        .groupBy("_k", "_chunk", "_no")
        .agg(F.min("_t").alias("_s"), F.max("_t").alias("_e"), F.sum("_n").alias("_n"))
    )
    whole = Window.partitionBy("_k", "_chunk")
    local = local.withColumn("_last", F.max("_no").over(whole))
    inner = local.where((F.col("_no") > 0) & (F.col("_no") < F.col("_last"))).select("_k", "_s", "_e", "_n")
    edge = local.where((F.col("_no") == 0) | (F.col("_no") == F.col("_last"))).select("_k", "_s", "_e", "_n")
    by_key = Window.partitionBy("_k").orderBy("_s")
    joins = F.coalesce((F.col("_s") - F.lag("_e").over(by_key) > gap_ms).cast("int"), F.lit(1))
    merged = (
        edge.withColumn("_new", joins)
        .withColumn("_id", F.sum("_new").over(by_key))
        .groupBy("_k", "_id")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"))
        .select("_k", "_s", "_e", "_n")
    )
    return inner.unionByName(merged).select(
        F.col("_k").alias(key),
        F.col("_s").alias("start_ms"),
        F.col("_e").alias("end_ms"),
        (F.col("_e") - F.col("_s")).alias("duration_ms"),
        F.col("_n").alias("n_events"),
    )
