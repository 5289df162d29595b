"""Document state from the operation log: visibility, registers, conflicts, counters, objects.

All readers take ``clock`` (see :func:`opweave.operators.graph.clock`): None reads the current state,
a clock the state of that version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import HEAD, ROOT, id_text
from .blocks import MAX_NODES, forest
from .graph import covered_ops

MAKE_MAP, SET, MAKE_LIST, DELETE, MAKE_TEXT, INCREMENT, MAKE_TABLE, MARK = range(8)
TYPES = {MAKE_MAP: "map", MAKE_LIST: "list", MAKE_TEXT: "text", MAKE_TABLE: "table"}
REGISTER = ["doc_id", "obj", "reg"]


def log_ops(ops: DataFrame) -> DataFrame:
    """Each operation once, however often it was delivered (any extra columns are dropped)."""
    cols = ["obj", "op_key", "elem", "is_insert", "op_action", "val", "mark_name", "expand", "pred"]
    return ops.groupBy("doc_id", "op").agg(F.min(F.struct(*cols)).alias("_o")).select("doc_id", "op", "_o.*")


def value_text(v: Column) -> Column:
    """A scalar as text: its value without its type; null for the null value, bytes as hex."""
    return F.coalesce(
        v["i"].cast("string"), v["u"].cast("string"), v["s"], v["d"].cast("string"), v["flag"].cast("string"), F.lower(F.hex(v["b"]))
    )


def visible_ops(ops: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """The visible members of every register: ``doc_id``, ``obj``, ``reg``, ``op``, ``elem``, ``op_action``, ``val``, ``n``.

    ``reg`` is the key of a map entry or the id of a sequence element as text.  An operation is visible
    if the clock covers it, it isn't a delete, an increment or a mark, and no covered operation names
    it in ``pred``; increments don't hide counters, of which ``n`` is the value with all covered
    increments that name it.  ``op``, ``obj`` and ``elem`` are id structs.
    """
    o = log_ops(ops if clock is None else covered_ops(ops, clock))
    own = F.struct(
        F.col("op").alias("target"),
        F.struct("op_action", "obj", "op_key", "elem", "is_insert", "val").alias("def"),
        F.lit(False).alias("gone"), F.lit(False).alias("inc_by"), F.lit(0).cast("bigint").alias("inc"),
    )
    is_inc = F.col("op_action") == INCREMENT

    def named(p: Column) -> Column:
        return F.struct(
            p.alias("target"),
            F.when(F.lit(False), F.struct("op_action", "obj", "op_key", "elem", "is_insert", "val")).alias("def"),
            (~is_inc).alias("gone"), is_inc.alias("inc_by"), F.when(is_inc, F.coalesce("val.i", F.lit(0))).otherwise(0).cast("bigint").alias("inc"),
        )

    none = F.expr("array()").cast("array<struct<ctr:bigint,actor:string>>")
    preds = F.filter(F.coalesce("pred", none), lambda p: p.isNotNull() & (p != F.col("op")))
    facts = o.select("doc_id", F.inline(F.concat(F.array(own), F.transform(preds, named))).alias("op", "def", "gone", "inc_by", "inc"))
    met = facts.groupBy("doc_id", "op").agg(F.max("def").alias("def"), F.max("gone").alias("gone"), F.max("inc_by").alias("inc_by"), F.sum("inc").alias("inc"))
    d = F.col("def")
    counter = F.coalesce(d["val"]["tag"] == "counter", F.lit(False))
    alive = d.isNotNull() & ~d["op_action"].isin(DELETE, INCREMENT, MARK) & ~F.col("gone") & (~F.col("inc_by") | counter)
    elem = F.when(d["is_insert"], F.col("op")).otherwise(d["elem"])
    return met.where(alive).select(
        "doc_id", d["obj"].alias("obj"), F.coalesce(d["op_key"], id_text(elem, HEAD)).alias("reg"), "op",
        F.when(d["op_key"].isNull(), elem).alias("elem"), d["op_action"].alias("op_action"), d["val"].alias("val"),
        F.when(counter, d["val"]["i"] + F.col("inc")).alias("n"),
    )


def _value() -> Column:
    made = F.coalesce(*[F.when(F.col("op_action") == a, F.lit(t)) for a, t in TYPES.items()])
    return F.coalesce(made, F.col("n").cast("string"), value_text(F.col("val"))).alias("value")


def _kind() -> Column:
    made = F.coalesce(*[F.when(F.col("op_action") == a, F.lit(t)) for a, t in TYPES.items()])
    return F.coalesce(made, F.col("val.tag")).alias("kind")


def get_all(visible: DataFrame) -> DataFrame:
    """Every visible value: ``doc_id``, ``obj_id``, ``reg``, ``op_id``, ``kind``, ``value``."""
    return visible.select("doc_id", id_text("obj").alias("obj_id"), "reg", id_text("op").alias("op_id"), _kind(), _value())


def winners(visible: DataFrame) -> DataFrame:
    """The winner of every register with ``n_values`` and ``conflict``; ``_at`` twins come from the clock of ``visible``."""
    top = F.max_by(F.struct("op", "elem", "op_action", "val", "n"), "op")
    return visible.groupBy(*REGISTER).agg(top.alias("_t"), F.count(F.lit(1)).alias("n_values")).select(
        *REGISTER, "_t.*", "n_values", (F.col("n_values") > 1).alias("conflict")
    )


def get(visible: DataFrame) -> DataFrame:
    """The winning value of every register: ``doc_id``, ``obj_id``, ``reg``, ``op_id``, ``kind``, ``value``, ``conflict``."""
    return winners(visible).select("doc_id", id_text("obj").alias("obj_id"), "reg", id_text("op").alias("op_id"), _kind(), _value(), "conflict")


def conflicts(visible: DataFrame) -> DataFrame:
    """All values of the registers that have more than one."""
    many = visible.groupBy(*REGISTER).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*REGISTER)
    return get_all(visible.join(many, REGISTER, "left_semi"))


def counters(visible: DataFrame) -> DataFrame:
    """``doc_id``, ``obj_id``, ``reg``, ``op_id``, ``n`` of every visible counter."""
    return visible.where(F.col("n").isNotNull()).select("doc_id", id_text("obj").alias("obj_id"), "reg", id_text("op").alias("op_id"), "n")


def keys(visible: DataFrame) -> DataFrame:
    """``doc_id``, ``obj_id``, ``op_key`` of every live map entry (order by ``op_key`` for the reference's byte order)."""
    return visible.where(F.col("elem").isNull()).select("doc_id", id_text("obj").alias("obj_id"), F.col("reg").alias("op_key")).distinct()


def map_range(visible: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Winning map entries with ``low`` <= key < ``high`` (None: unbounded)."""
    rows = visible.where(F.col("elem").isNull())
    if low is not None:
        rows = rows.where(F.col("reg") >= low)
    if high is not None:
        rows = rows.where(F.col("reg") < high)
    return get(rows)


def lengths(visible: DataFrame) -> DataFrame:
    """``doc_id``, ``obj_id``, ``length``: live entries of maps, live elements of sequences."""
    regs = visible.select(*REGISTER).distinct()
    return regs.groupBy("doc_id", "obj").agg(F.count("reg").alias("length")).select("doc_id", id_text("obj").alias("obj_id"), "length")


def objects(ops: DataFrame) -> DataFrame:
    """``doc_id``, ``obj_id``, ``obj_type``, ``parent_id``, ``reg``: every object ever made and where."""
    made = log_ops(ops).where(F.col("op_action").isin(*TYPES))
    elem = F.when(F.col("is_insert"), F.col("op")).otherwise(F.col("elem"))
    kind = F.coalesce(*[F.when(F.col("op_action") == a, F.lit(t)) for a, t in TYPES.items()])
    return made.select("doc_id", id_text("op").alias("obj_id"), kind.alias("obj_type"), id_text("obj").alias("parent_id"), F.coalesce("op_key", id_text(elem, HEAD)).alias("reg"))


def object_kinds(objects_: DataFrame) -> DataFrame:
    """How many objects of each type each document has."""
    return objects_.groupBy("doc_id", "obj_type").agg(F.count(F.lit(1)).alias("n_objects"))


def paths(ops: DataFrame, visible: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """``doc_id``, ``obj_id``, ``path`` (keys and element ids from the root), ``depth``, ``visible``: where every object lies.

    Components that are deleted or have lost their register to another value are still in the path;
    ``visible`` tells whether all of them can be seen.  Objects whose parents were never made, or hang
    in a loop, have no path and are left out.
    """
    o = objects(ops)
    live = winners(visible).select("doc_id", id_text("op").alias("obj_id"), F.lit(True).alias("_seen"))
    o = o.join(live, ["doc_id", "obj_id"], "left")
    nodes = o.select(
        F.col("doc_id").cast("string").alias("g"), F.split("obj_id", "@")[0].cast("bigint").alias("ord"), F.col("obj_id").alias("id"),
        F.when(F.col("parent_id") != ROOT, F.col("parent_id")).alias("parent"), "parent_id", "reg", F.col("_seen").isNotNull().alias("_seen"),
    )
    tree = forest(nodes.select("g", "ord", "id", "parent"), nodes.select("g", "ord"), with_path=True, max_nodes=max_nodes).where(~F.col("endless"))
    rooted = tree.join(nodes.where(F.col("parent_id") == ROOT).select("g", F.col("id").alias("root")), ["g", "root"], "left_semi")
    step = rooted.select("g", "node_no", "id").join(nodes.select("g", "id", "reg", "_seen"), ["g", "id"]).drop("id")
    parts = rooted.select("g", "id", F.col("depth"), F.posexplode("path").alias("_at", "node_no")).join(step, ["g", "node_no"])
    whole = parts.groupBy("g", "id", "depth").agg(F.array_sort(F.collect_list(F.struct("_at", "reg"))).alias("_p"), F.min("_seen").alias("visible"))
    return whole.select(
        F.col("g").cast("bigint").alias("doc_id"), F.col("id").alias("obj_id"), F.array_join(F.transform("_p", lambda p: p["reg"]), "/").alias("path"), "depth", "visible"
    )


def iterate(visible: DataFrame, order: DataFrame) -> DataFrame:
    """The winning items of all objects in reading order: ``doc_id``, ``obj_id``, ``item_no``, ``reg``, ``kind``, ``value``.

    Maps by key, sequences by place; ``item_no`` counts from 0 within an object.  Sorting by (counter,
    actor) of the object's id gives parents before children.
    """
    w = Window.partitionBy("doc_id", "obj").orderBy("pos", "reg")
    rows = winners(visible).join(order, ["doc_id", "obj", "elem"], "left").where(F.col("elem").isNull() | F.col("pos").isNotNull())
    return rows.withColumn("item_no", F.row_number().over(w).cast("bigint") - 1).select("doc_id", id_text("obj").alias("obj_id"), "item_no", "reg", _kind(), _value())


def invalid_ops(ops: DataFrame) -> DataFrame:
    """Operations that a strict load refuses: ``doc_id``, ``op_id``, ``error``.

    ``InvalidOp``: a map key in a sequence or an element in a map; ``InvalidObjId``: an object that
    wasn't made; ``NotAnObject``: one that is a scalar; ``MissingCounter``: an increment none of whose
    predecessors is a counter; ``InvalidOpType``: an unknown action or an increment without a number.
    """
    o = log_ops(ops)
    at = o.select("doc_id", F.col("op").alias("obj"), F.col("op_action").alias("_made")).distinct()
    kinded = o.join(at, ["doc_id", "obj"], "left")
    root, sequence = F.col("obj.ctr") == 0, F.col("_made").isin(MAKE_LIST, MAKE_TEXT)
    error = (
        F.when(~F.col("op_action").between(0, 7) | ((F.col("op_action") == INCREMENT) & F.col("val.i").isNull()), "InvalidOpType")
        .when(~root & F.col("_made").isNull(), "InvalidObjId")
        .when(~root & ~F.col("_made").isin(*TYPES), "NotAnObject")
        .when((root | ~sequence) & F.col("op_key").isNull(), "InvalidOp")
        .when(~root & sequence & F.col("op_key").isNotNull(), "InvalidOp")
    )
    found = kinded.select("doc_id", id_text("op").alias("op_id"), error.alias("error")).where(F.col("error").isNotNull())
    inc = o.where(F.col("op_action") == INCREMENT)
    counter = o.where(F.col("val.tag") == "counter").select("doc_id", F.col("op").alias("p"))
    with_counter = inc.select("doc_id", "op", F.explode("pred").alias("p")).join(counter, ["doc_id", "p"], "left_semi").select("doc_id", "op")
    lost = inc.join(with_counter, ["doc_id", "op"], "left_anti").select("doc_id", id_text("op").alias("op_id"), F.lit("MissingCounter").alias("error"))
    return found.unionByName(lost)
