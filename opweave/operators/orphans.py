"""References to records that don't exist, and what hangs on the records that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import clean_id, clean_op, id_text
from .blocks import MAX_NODES, close
from .delivery import with_hashes


def change_references(changes: DataFrame) -> DataFrame:
    """``doc_id``, ``referrer_id`` (the change's hash), ``target_id``, ``delivery_id`` for each entry of ``deps``, copies included.

    A delivery without a hash speaks for the change with the same ``doc_id``, ``actor`` and ``seq``; if
    none has a hash, ``referrer_id`` is null.  Null and empty entries of ``deps`` are no references.
    """
    c = with_hashes(changes.select("delivery_id", "doc_id", "hash", "actor", "seq", "deps"))
    return c.select("doc_id", F.col("hash").alias("referrer_id"), F.explode("deps").alias("target_id"), "delivery_id")


def change_targets(changes: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """Distinct (``doc_id``, ``target_id``) of changes and archived hashes."""
    known = changes.select("doc_id", clean_id("hash").alias("target_id"))
    if archive is not None:
        known = known.unionByName(archive.select("doc_id", clean_id("hash").alias("target_id")))
    return known.where(F.col("target_id").isNotNull()).distinct()


def op_references(ops: DataFrame) -> DataFrame:
    """``doc_id``, ``referrer`` and ``target`` id structs and ``delivery_id`` for each entry of ``pred``, repeats included."""
    r = ops.select("doc_id", clean_op("op").alias("referrer"), F.explode("pred").alias("target"), "delivery_id")
    return r.where(F.col("target").isNotNull()).withColumn("target", clean_op("target"))


def orphan_cascade(
    changes: DataFrame, ops: DataFrame, archive: DataFrame | None = None, inherited: bool = True, max_nodes: int = MAX_NODES
) -> DataFrame:
    """Orphans from the references down: ``ref_table``, ``doc_id``, ``record_id``, ``target_id``, ``level``, ``first_id``.

    Level 0 has a row for each distinct reference that leads nowhere in all the data, however late its
    target arrives: the anti join of all references with the records of the same document.  Known
    records are reduced to distinct ids on the map side; the references are the streamed side,
    where AQE splits a target that very many of them name.  A reference with a null ``doc_id`` leads nowhere,
    and ``record_id`` is null where no delivery of the change has a hash.

    Level 1 (unless ``inherited`` is false, which ends the cascade at its first step) has a row, with a null
    ``target_id``, for each record that isn't at level 0 but hangs on one that is: the fixpoint of semi-joins
    down the links, whose rounds follow links to their ends within blocks of documents and so count
    block borders, not the depth of the graph.

    ``first_id`` is the first delivery of the reference (level 0) or of the record (level 1).
    """
    keys = ["ref_table", "doc_id", "record_id", "target_id"]
    of_changes = (
        change_references(changes)
        .join(change_targets(changes, archive), ["doc_id", "target_id"], "left_anti")
        .select(F.lit("changes").alias("ref_table"), "doc_id", F.col("referrer_id").alias("record_id"), "target_id", "delivery_id")
    )
    of_ops = (
        op_references(ops)
        .join(ops.select("doc_id", clean_op("op").alias("target")).distinct(), ["doc_id", "target"], "left_anti")
        .select(F.lit("ops").alias("ref_table"), "doc_id", id_text("referrer").alias("record_id"), id_text("target").alias("target_id"), "delivery_id")
    )
    direct = of_changes.unionByName(of_ops).groupBy(*keys).agg(F.min("delivery_id").alias("first_id")).withColumn("level", F.lit(0))
    columns = [*keys, "level", "first_id"]
    if not inherited:
        return direct.select(*columns)
    direct = cut(direct.select(*columns))
    g = F.col("doc_id").cast("string").alias("g")
    c = with_hashes(changes.select("delivery_id", "doc_id", "hash", "actor", "seq", "start_op", "deps")).where(F.col("hash").isNotNull())
    change_nodes = c.groupBy(g, F.col("hash").alias("id")).agg(
        F.min("start_op").alias("ord"),
        F.array_distinct(F.flatten(F.collect_set("deps"))).alias("parents"),
        F.min("delivery_id").alias("first_id"),
    )
    no_pred = F.expr("array()").cast("array<struct<ctr:bigint,actor:string>>")
    op_nodes = ops.groupBy(g, clean_op("op").alias("op")).agg(F.collect_set(F.coalesce("pred", no_pred)).alias("_p"), F.min("delivery_id").alias("first_id"))
    op_nodes = op_nodes.select(
        "g", id_text("op").alias("id"), F.col("op.ctr").alias("ord"), F.transform(F.array_distinct(F.flatten("_p")), lambda p: id_text(p)).alias("parents"), "first_id"
    )
    out = direct
    for name, nodes, order in (("changes", change_nodes, (changes, "start_op")), ("ops", op_nodes, (ops, "op.ctr"))):
        seeds = direct.where(F.col("ref_table") == name).select(g, F.col("record_id").alias("id"), F.lit(True).alias("seed")).distinct()
        seeded = nodes.join(seeds, ["g", "id"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
        sizing = order[0].select(g, F.col(order[1]).alias("ord"))
        below = close(seeded, sizing, "any", max_nodes, carry="seed boolean, first_id bigint").where(F.col("flag") & ~F.col("seed"))
        out = out.unionByName(
            below.select(
                F.lit(name).alias("ref_table"), F.col("g").cast("bigint").alias("doc_id"), F.col("id").alias("record_id"),
                F.lit(None).cast("string").alias("target_id"), F.lit(1).alias("level"), "first_id",
            )
        )
    return out


def orphan_references(changes: DataFrame, ops: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """Distinct references that lead nowhere: ``ref_table``, ``doc_id``, ``referrer_id``, ``target_id``; level 0 of :func:`orphan_cascade`."""
    return orphan_cascade(changes, ops, archive, inherited=False).select("ref_table", "doc_id", F.col("record_id").alias("referrer_id"), "target_id")


def orphan_report(
    changes: DataFrame, ops: DataFrame, archive: DataFrame | None = None, period: str = "week", max_nodes: int = MAX_NODES
) -> DataFrame:
    """``ref_table``, ``period``, ``n_references``, ``n_direct``, ``n_inherited``.

    Orphan references by the period in which they were first delivered; of their records those first
    delivered as orphans in the period; and records that only hang on others, by their first delivery.
    """
    when = changes.select(F.col("delivery_id").alias("first_id"), F.date_trunc(period, "received_at").cast("date").alias("period"))
    rows = orphan_cascade(changes, ops, archive, max_nodes=max_nodes)
    whole = rows.groupBy("ref_table", "doc_id", "record_id", "level").agg(F.min("first_id").alias("first_id"))
    named = F.col("record_id").isNotNull()
    counted = rows.where(F.col("level") == 0).select("ref_table", "first_id", F.lit(1).alias("r"), F.lit(0).alias("d"), F.lit(0).alias("i"))
    counted = counted.unionByName(
        whole.select("ref_table", "first_id", F.lit(0).alias("r"), (named & (F.col("level") == 0)).cast("int").alias("d"), (F.col("level") == 1).cast("int").alias("i"))
    )
    sums = [F.sum(c).alias(n) for c, n in (("r", "n_references"), ("d", "n_direct"), ("i", "n_inherited"))]
    return counted.groupBy("ref_table", "first_id").agg(*[F.sum(c).alias(c) for c in "rdi"]).join(when, "first_id", "left").groupBy("ref_table", "period").agg(*sums)
