"""Differences between two versions as patches, and applying them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import id_text
from .graph import clock
from .state import REGISTER, _kind, _value, visible_ops, winners


def register_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """The registers that differ between two sets of visible operations: a row of patch each.

    ``doc_id``, ``obj_id``, ``reg``, ``action`` (``put``, ``delete``, ``conflict``, ``increment``), ``value``, ``kind``,
    ``op_id``, ``delta``, ``conflict``.  The last member in order of ids decides: a new winner is put; the
    same counter with another sum is incremented by ``delta``; the same winner that has come to have
    rivals, or lost them, is a conflict patch; a register without members is deleted.
    """

    def side(v: DataFrame, p: str) -> DataFrame:
        return winners(v).select(*REGISTER, F.struct("op", "elem", "op_action", "val", "n", "n_values", "conflict").alias(p))

    both = side(before, "b").join(side(after, "a"), REGISTER, "full_outer")
    same = F.col("b.op") == F.col("a.op")
    delta = F.col("a.n") - F.col("b.n")
    action = (
        F.when(F.col("a").isNull(), "delete")
        .when(F.col("b").isNull() | ~same, "put")
        .when(same & (delta != 0), "increment")
        .when(same & (F.col("a.conflict") != F.col("b.conflict")), "conflict")
    )
    now = F.col("action") != "delete"
    return both.withColumn("action", action).where(F.col("action").isNotNull()).select(
        "doc_id", id_text("obj").alias("obj_id"), "reg", "action",
        F.when(now, F.col("a")).alias("_a"), F.when(F.col("action") == "increment", delta).alias("delta"),
    ).select("doc_id", "obj_id", "reg", "action", "delta", "_a.*").select(
        "doc_id", "obj_id", "reg", "action",
        F.when(F.col("action").isin("put", "increment"), _value()).alias("value"),
        F.when(F.col("action") == "put", _kind()).alias("kind"),
        F.when(F.col("op").isNotNull(), id_text("op")).alias("op_id"), "delta", "conflict",
    )


def diff_versions(changes: DataFrame, ops: DataFrame, before: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Patches from one version (``doc_id``, ``hash`` of heads) to another, in either direction; None is the current one.

    Only documents of ``before`` are compared.
    """
    docs = before.select("doc_id").distinct()
    mine = ops.join(docs, "doc_id", "left_semi")
    there = None if after is None else clock(changes, after)
    return register_diff(visible_ops(mine, clock(changes, before)), visible_ops(mine, there))


def within(patches: DataFrame, paths: DataFrame, doc_id: int, path: str) -> DataFrame:
    """The patches to one object and all objects in it; ``path`` as :func:`state.paths` has it."""
    inside = paths.where((F.col("doc_id") == doc_id) & ((F.col("path") == path) | F.startswith("path", F.lit(path + "/"))))
    return patches.join(inside.select("doc_id", "obj_id"), ["doc_id", "obj_id"], "left_semi")


def current_state(after: DataFrame) -> DataFrame:
    """The patches from nothing to a state."""
    return register_diff(after.limit(0), after)


def apply_patches(state: DataFrame, patches: DataFrame) -> DataFrame:
    """``doc_id``, ``obj_id``, ``reg``, ``kind``, ``value``, ``conflict`` of ``state`` (as :func:`state.get` gives it) after ``patches``."""
    key = ["doc_id", "obj_id", "reg"]
    s = state.select(*key, F.struct("kind", "value", "conflict").alias("s"))
    p = patches.select(*key, F.struct("action", "kind", "value", "conflict").alias("p"))
    j = s.join(p, key, "full_outer").where(F.col("p").isNull() | (F.col("p.action") != "delete"))
    new = F.col("p.action").isin("put", "increment")
    kind = F.when(F.col("p.action") == "put", F.col("p.kind")).otherwise(F.col("s.kind"))
    return j.select(*key, kind.alias("kind"), F.when(new, F.col("p.value")).otherwise(F.col("s.value")).alias("value"), F.coalesce("p.conflict", "s.conflict").alias("conflict"))


def list_diff(before: DataFrame, after: DataFrame, order: DataFrame) -> DataFrame:
    """Sequence patches in order: ``doc_id``, ``obj_id``, ``patch_no``, ``action`` (``insert``, ``delete``, ``put``), ``idx``, ``kind``, ``value``.

    Read from the first element on: ``idx`` is the place in the new state at which the element is
    inserted or put, or from which one is deleted, as elements before it are already as in the new.
    """
    cols = ["doc_id", "obj", "elem"]

    def side(v: DataFrame, p: str) -> DataFrame:
        return winners(v.where(F.col("elem").isNotNull())).select(*cols, F.struct("op", "op_action", "val", "n").alias(p))

    both = side(before, "b").join(side(after, "a"), cols, "full_outer").join(order, cols)
    w = Window.partitionBy("doc_id", "obj").orderBy("pos")
    idx = F.coalesce(F.sum(F.col("a").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    action = F.when(F.col("a").isNull(), "delete").when(F.col("b").isNull(), "insert").when(
        (F.col("a.op") != F.col("b.op")) | ~F.col("a.n").eqNullSafe(F.col("b.n")), "put"
    )
    rows = both.withColumns({"idx": idx, "action": action}).where(F.col("action").isNotNull())
    return rows.withColumn("patch_no", F.row_number().over(w).cast("bigint")).select("doc_id", "obj", "patch_no", "action", "idx", "a.*").select(
        "doc_id", id_text("obj").alias("obj_id"), "patch_no", "action", "idx", _kind(), _value()
    )


def coalesce_patches(patches: DataFrame) -> DataFrame:
    """Neighbouring inserts and deletes of :func:`list_diff` joined: ``doc_id``, ``obj_id``, ``first_no``, ``action``, ``idx``, ``n``, ``values``."""
    w = Window.partitionBy("doc_id", "obj_id").orderBy("patch_no")
    same = F.lag("action").over(w) == F.col("action")
    step = F.lag("idx").over(w)
    joins = same & (((F.col("action") == "insert") & (F.col("idx") == step + 1)) | ((F.col("action") == "delete") & (F.col("idx") == step)))
    runs = patches.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("patch_no", "value")))
    return runs.groupBy("doc_id", "obj_id", "_run", "action").agg(
        F.min("patch_no").alias("first_no"), F.min("idx").alias("idx"), F.count(F.lit(1)).alias("n"), F.transform(parts, lambda p: p["value"]).alias("values")
    ).drop("_run")
