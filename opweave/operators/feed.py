"""Applying a feed of operations, repeated and in any order, to find current entries.

The fold is commutative and idempotent: every fact about an operation (its definition, or that
another operation supersedes it) is one row, and facts meet in a maximum per operation.  Facts
about operations that haven't arrived stay as tombstones and take effect when they do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import id_text

DELETE, INCREMENT = 3, 5
_BY_INCREMENT, _BY_OTHER = 1, 2


def op_facts(ops: DataFrame) -> DataFrame:
    """``doc_id``, ``ctr``, ``actor`` of an operation with ``def`` (if this row defines it) or ``gone`` (if this row supersedes it).

    ``gone`` is 1 when an increment names the operation in ``pred`` and 2 when another does.
    """
    o = ops.select(
        "doc_id",
        F.col("op.ctr").alias("ctr"),
        F.lower(F.trim("op.actor")).alias("actor"),
        F.struct(
            F.col("op_action").alias("action"),
            (F.col("val.tag") == "counter").alias("counter"),
            F.col("obj.ctr").alias("obj_ctr"),
            F.lower(F.trim("obj.actor")).alias("obj_actor"),
            F.col("op_key").alias("key"),
        ).alias("def"),
        F.when(F.col("op_action") == INCREMENT, _BY_INCREMENT).otherwise(_BY_OTHER).alias("level"),
        F.transform("pred", lambda p: F.struct(p["ctr"].alias("ctr"), F.lower(F.trim(p["actor"])).alias("actor"))).alias("pred"),
    )
    # one generator gives the definition and the tombstones, so the log is scanned once
    own = F.struct("ctr", "actor", F.col("def"), F.lit(0).alias("gone"))
    tomb = lambda p: F.struct(p["ctr"].alias("ctr"), p["actor"].alias("actor"), F.when(F.lit(False), F.col("def")).alias("def"), F.col("level").alias("gone"))
    others = F.filter(
        F.coalesce("pred", F.expr("array()").cast("array<struct<ctr:bigint,actor:string>>")),
        lambda p: p.isNotNull() & ~((p["ctr"] == F.col("ctr")) & (p["actor"] == F.col("actor"))),
    )
    facts = F.concat(F.array(own), F.transform(others, tomb))
    return o.select("doc_id", F.inline(facts).alias("ctr", "actor", "def", "gone"))


def fold_ops(facts: DataFrame) -> DataFrame:
    """Facts met per operation; folding folded facts with newer ones gives the same as folding all at once."""
    return facts.groupBy("doc_id", "ctr", "actor").agg(F.max("def").alias("def"), F.max("gone").alias("gone"))


def live_ops(folded: DataFrame) -> DataFrame:
    """Defined operations, without deletes and increments, that nothing supersedes."""
    gone = (F.col("gone") == _BY_OTHER) | ((F.col("gone") == _BY_INCREMENT) & ~F.coalesce("def.counter", F.lit(False)))
    alive = F.col("def").isNotNull() & ~F.col("def.action").isin(DELETE, INCREMENT) & ~gone
    return folded.where(alive).select("doc_id", "ctr", "actor", "def.*")


def base_facts(base: DataFrame) -> DataFrame:
    """Rows of an earlier state (``doc_id``, ``op``, ``obj``, ``op_key``, ``op_action``) as facts."""
    return op_facts(
        base.select(
            "doc_id",
            "op",
            "obj",
            "op_key",
            "op_action",
            F.lit(None).cast("struct<tag:string>").alias("val"),
            F.array().cast("array<struct<ctr:bigint,actor:string>>").alias("pred"),
        )
    )


def current_entries(ops: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The winning operation of every live map entry: ``doc_id``, ``obj_id``, ``op_key``, ``op_id``.

    ``base`` adds the rows of a state from before the log.  Both aggregations combine on the map
    side, so an entry or operation that a third of all rows name is no hot spot.  Ids compare in
    lower case, (``ctr``, ``actor``) orders operations, an operation's own id in its ``pred`` is
    ignored, and entries with a null ``op_key`` are left out.
    """
    facts = op_facts(ops)
    if base is not None:
        facts = facts.unionByName(base_facts(base))
    live = live_ops(fold_ops(facts)).where(F.col("key").isNotNull())
    won = live.groupBy("doc_id", "obj_ctr", "obj_actor", "key").agg(F.max(F.struct("ctr", "actor")).alias("op"))
    return won.select(
        "doc_id",
        id_text(F.struct(F.col("obj_ctr").alias("ctr"), F.col("obj_actor").alias("actor"))).alias("obj_id"),
        F.col("key").alias("op_key"),
        id_text("op").alias("op_id"),
    )
