"""The change graph of each document: heads, ancestors, clocks, differences of histories.

A *version* is a DataFrame (``doc_id``, ``hash``) of heads, any number for each document.  Operators take
the distinct changes (see :func:`opweave.operators.delivery.keep_first`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MAX_NODES, close

KEY = ["doc_id", "hash"]


def edges(changes: DataFrame) -> DataFrame:
    """``doc_id``, ``hash``, ``dep`` for each entry of ``deps``."""
    return changes.select(*KEY, F.explode("deps").alias("dep"))


def heads(changes: DataFrame) -> DataFrame:
    """Changes that no change of the document depends on."""
    used = edges(changes).select("doc_id", F.col("dep").alias("hash"))
    return changes.select(*KEY).join(used, KEY, "left_anti")


def head_sets(changes: DataFrame) -> DataFrame:
    """``doc_id``, ``heads``: the version of each document as a sorted array."""
    return heads(changes).groupBy("doc_id").agg(F.sort_array(F.collect_set("hash")).alias("heads"))


def ancestors(changes: DataFrame, version: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """``doc_id``, ``hash`` of the heads of ``version`` and all their ancestors; unknown heads are ignored."""
    seeds = version.select(F.col("doc_id").cast("string").alias("g"), F.col("hash").alias("id"), F.lit(True).alias("_seed")).distinct()
    nodes = changes.select(F.col("doc_id").cast("string").alias("g"), F.col("start_op").alias("ord"), F.col("hash").alias("id"), F.col("deps").alias("parents"))
    seeded = nodes.join(seeds, ["g", "id"], "left").withColumn("seed", F.col("_seed").isNotNull()).drop("_seed")
    done = close(seeded, nodes.select("g", "ord"), "up", max_nodes)
    return done.where("flag").select(F.col("g").cast("bigint").alias("doc_id"), F.col("id").alias("hash"))


def clock(changes: DataFrame, version: DataFrame | None = None, max_nodes: int = MAX_NODES) -> DataFrame:
    """``doc_id``, ``actor``, ``max_op``, ``max_seq``: the vector clock of a version (None: of everything)."""
    covered = changes if version is None else changes.join(ancestors(changes, version, max_nodes), KEY, "left_semi")
    return covered.groupBy("doc_id", "actor").agg(F.max("max_op").alias("max_op"), F.max("seq").alias("max_seq"))


def covered_ops(ops: DataFrame, clock_: DataFrame) -> DataFrame:
    """The operations a clock covers: those up to its counter of their actor."""
    c = clock_.select("doc_id", F.col("actor").alias("_actor"), F.col("max_op").alias("_max"))
    on = (ops["doc_id"] == c["doc_id"]) & (ops["op.actor"] == c["_actor"]) & (ops["op.ctr"] <= c["_max"])
    return ops.join(c, on, "left_semi")


def changes_since(changes: DataFrame, version: DataFrame) -> DataFrame:
    """All changes that aren't the version's heads or ancestors of them."""
    return changes.join(ancestors(changes, version), KEY, "left_anti")


def changes_added(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """The changes of ``theirs`` that ``mine`` hasn't."""
    return theirs.join(mine.select(*KEY), KEY, "left_anti")


def without_ancestors(hashes: DataFrame, changes: DataFrame, version: DataFrame) -> DataFrame:
    """The given (``doc_id``, ``hash``) that aren't among a version's heads and their ancestors."""
    return hashes.join(ancestors(changes, version), KEY, "left_anti")


def missing_deps(changes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``hash`` that changes depend on (or that are ``wanted``) and that aren't there."""
    asked = edges(changes).select("doc_id", F.col("dep").alias("hash"))
    if wanted is not None:
        asked = asked.unionByName(wanted.select(*KEY))
    return asked.join(changes.select(*KEY), KEY, "left_anti").distinct()


def ready(changes: DataFrame, applied: DataFrame | None = None, max_nodes: int = MAX_NODES) -> DataFrame:
    """``doc_id``, ``hash``, ``ready``: a change is ready once all it depends on, however far back, is there.

    Dependencies may be in the batch or among ``applied`` (``doc_id``, ``hash``).  What waits does so for
    a change that is missing, or on a loop.
    """
    known = changes.select(*KEY) if applied is None else changes.select(*KEY).unionByName(applied.select(*KEY))
    lacks = edges(changes).join(known.select("doc_id", F.col("hash").alias("dep")), ["doc_id", "dep"], "left_anti").select(*KEY).distinct()
    nodes = changes.select(F.col("doc_id").cast("string").alias("g"), F.col("start_op").alias("ord"), F.col("hash").alias("id"), F.col("deps").alias("parents"))
    sizing = nodes.select("g", "ord")
    seeds = lacks.select(F.col("doc_id").cast("string").alias("g"), F.col("hash").alias("id"), F.lit(True).alias("_s"))
    seeded = nodes.join(seeds, ["g", "id"], "left").withColumn("seed", F.col("_s").isNotNull()).drop("_s")
    waits = close(seeded, sizing, "any", max_nodes).select("g", "id", F.col("flag").alias("waits"))
    sound = close(nodes, sizing, "all", max_nodes).select("g", "id", F.col("flag").alias("sound"))
    return waits.join(sound, ["g", "id"]).select(
        F.col("g").cast("bigint").alias("doc_id"), F.col("id").alias("hash"), (~F.col("waits") & F.col("sound")).alias("ready")
    )


def duplicate_seqs(changes: DataFrame) -> DataFrame:
    """``doc_id``, ``actor``, ``seq``, ``n_hashes`` where an actor used a sequence number for different changes."""
    return (
        changes.groupBy("doc_id", "actor", "seq", "hash").agg(F.lit(1).alias("one"))
        .groupBy("doc_id", "actor", "seq").agg(F.count("hash").alias("n_hashes")).where(F.col("n_hashes") > 1)
    )


def seq_gaps(changes: DataFrame) -> DataFrame:
    """``doc_id``, ``actor``, ``n_missing``: sequence numbers from 1 to an actor's last that no change has."""
    per = changes.select("doc_id", "actor", "seq").distinct().groupBy("doc_id", "actor").agg(F.max("seq").alias("last"), F.count("seq").alias("n"))
    return per.where(F.col("last") > F.col("n")).select("doc_id", "actor", (F.col("last") - F.col("n")).alias("n_missing"))


def op_changes(ops: DataFrame, changes: DataFrame) -> DataFrame:
    """``doc_id``, ``ctr``, ``actor``, ``hash``: the change whose counter interval holds each operation of its actor.

    An interval join as an equi-join: intervals are cut into the slots of 64 counters they touch.
    """
    slot = 64
    slots = F.explode(F.sequence(F.expr(f"start_op div {slot}"), F.expr(f"max_op div {slot}"))).alias("_slot")
    spans = changes.where(F.col("start_op") <= F.col("max_op")).select("doc_id", "actor", "start_op", "max_op", "hash", slots)
    points = ops.select("doc_id", F.col("op.ctr").alias("ctr"), F.col("op.actor").alias("actor")).distinct().withColumn("_slot", F.expr(f"ctr div {slot}"))
    hit = points.join(spans, ["doc_id", "actor", "_slot"]).where(F.col("ctr").between(F.col("start_op"), F.col("max_op")))
    return hit.select("doc_id", "ctr", "actor", "hash")


def last_changes(changes: DataFrame) -> DataFrame:
    """``doc_id``, ``actor``, ``hash``, ``seq``: each actor's last change of each document."""
    return changes.groupBy("doc_id", "actor").agg(F.max_by("hash", F.struct("seq", "hash")).alias("hash"), F.max("seq").alias("seq"))


def fork(changes: DataFrame, ops: DataFrame, version: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The changes and operations of a version alone.  Strict: an unknown head is an error."""
    if strict and not version.join(changes.select(*KEY), KEY, "left_anti").isEmpty():
        raise ValueError("InvalidHash: a head is not in the history")
    kept = changes.join(ancestors(changes, version), KEY, "left_semi")
    mine = kept.select("doc_id", F.col("hash").alias("change_hash"))
    return kept, ops.join(mine, ["doc_id", "change_hash"], "left_semi")


def topological(changes: DataFrame) -> DataFrame:
    """Changes with ``topo_key``: sorting a document by it puts every change after its ancestors (where counters are sound)."""
    return changes.withColumn("topo_key", F.struct("start_op", "max_op", "actor", "hash"))


def stats(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """``doc_id``, ``n_changes``, ``n_actors``, ``n_ops`` (deletes don't count) of each document."""
    c = changes.groupBy("doc_id").agg(F.count("hash").alias("n_changes"), F.count_distinct("actor").alias("n_actors"))
    o = ops.where(F.col("op_action") != 3).select("doc_id", "op").distinct().groupBy("doc_id").agg(F.count("op").alias("n_ops"))
    return c.join(o, "doc_id", "left").withColumn("n_ops", F.coalesce("n_ops", F.lit(0)))


def contains_version(changes: DataFrame, version: DataFrame) -> DataFrame:
    """``doc_id``, ``has_heads``: whether all heads of a version are in the history."""
    there = changes.select(*KEY).withColumn("_there", F.lit(True))
    return version.join(there, KEY, "left").groupBy("doc_id").agg(F.min(F.col("_there").isNotNull()).alias("has_heads"))


def merge_commit(changes: DataFrame, actor: str, time_ms: int = 0, message: str | None = None) -> DataFrame:
    """One change without operations for each document, which depends on all its heads.

    Its hash is the SHA-256 of its content as text.
    """
    per = changes.groupBy("doc_id").agg(F.max("max_op").alias("_m"), F.coalesce(F.max(F.when(F.col("actor") == actor, F.col("seq"))), F.lit(0)).alias("_s"))
    c = per.join(head_sets(changes), "doc_id").select(
        "doc_id", F.lit(actor).alias("actor"), (F.col("_s") + 1).alias("seq"), (F.col("_m") + 1).alias("start_op"), F.col("_m").alias("max_op"),
        F.lit(0).cast("bigint").alias("num_ops"), F.lit(time_ms).cast("bigint").alias("time_ms"), F.lit(message).cast("string").alias("message"), F.col("heads").alias("deps"),
    )
    return c.withColumn("hash", F.sha2(F.to_json(F.struct(*c.columns)), 256))
