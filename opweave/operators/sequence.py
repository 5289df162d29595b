"""Order of sequence elements, positions and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import id_text
from .blocks import MAX_NODES, forest
from .state import log_ops


def element_order(ops: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """``doc_id``, ``obj``, ``elem``, ``pos``: every inserted element and its place (from 1), deleted ones and marks included.

    Of pieces (:func:`opweave.operators.runs.pieces`) the first element and its place, with their ``run_n`` and ``run``.

    Elements form a tree (an insert hangs on the element it follows) that is read in pre-order,
    siblings by descending operation id.  The tour down and up the tree is one chain per object, and
    an element's place is the number of steps down to it: a weighted forest of single links, which
    blocks of bounded size rank and merge, so one huge text is not one task and a text typed in one
    go is no deep recursion.  Elements that hang on an insert that was never delivered, or on a loop,
    have no place and are left out.
    """
    extra = [c for c in ("run_n", "run") if c in ops.columns]
    # as in log_ops, without what isn't needed; what was delivered both in a run and alone is of the run
    held = ops.where("is_insert").groupBy("doc_id", "op").agg(F.min(F.struct("obj", "op_key", "elem")).alias("_o"), *[F.max(c).alias(c) for c in extra])
    ins = held.select("doc_id", "op", "_o.obj", F.col("_o.elem").alias("ref"), *extra).where(F.col("ref").isNotNull())
    n = F.col("run_n") if extra else F.lit(1)
    # nodes have the name of the last element of their row: it is what others follow
    ins = ins.withColumn("end", F.struct((F.col("op.ctr") + n - 1).alias("ctr"), F.col("op.actor").alias("actor")))
    siblings = Window.partitionBy("doc_id", "obj", "ref").orderBy(F.col("op").desc())
    placed = ins.withColumn("_before", F.lag("end").over(siblings))
    last = ins.groupBy("doc_id", "obj", "ref").agg(F.min(F.struct("op", "end"))["end"].alias("_last")).withColumnRenamed("ref", "end")
    tour = placed.join(last, ["doc_id", "obj", "end"], "left")
    head = F.col("ref.ctr") == 0
    down = F.concat(F.lit("d"), id_text("end"))
    into = F.when(F.col("_before").isNotNull(), F.concat(F.lit("u"), id_text("_before"))).when(~head, F.concat(F.lit("d"), id_text("ref"))).otherwise(F.lit("h"))
    up = F.concat(F.lit("u"), id_text("end"))
    out_of = F.when(F.col("_last").isNotNull(), F.concat(F.lit("u"), id_text("_last"))).otherwise(down)
    start = head & F.col("_before").isNull()
    group = F.concat_ws("/", F.col("doc_id").cast("string"), id_text("obj"))
    order = F.col("op.ctr")
    step = lambda id, parent, w: F.struct(id.alias("id"), parent.alias("parent"), w.cast("bigint").alias("w"))
    # every tour that is whole begins at the node h of its object
    ways = F.array(step(down, into, n), step(up, out_of, F.lit(0)))
    ways = F.when(start, F.concat(ways, F.array(step(F.lit("h"), F.lit(None).cast("string"), F.lit(0))))).otherwise(ways)
    nodes = tour.select(group.alias("g"), order.alias("ord"), F.inline(ways).alias("id", "parent", "w"))
    ranked = forest(nodes, ins.select(group.alias("g"), F.explode(F.array(order, order)).alias("ord")), max_nodes=max_nodes, weight="w")
    reached = ranked.where((F.col("root") == "h") & F.col("id").startswith("d"))
    at = reached.select(F.col("g").alias("_g"), F.col("id").alias("_id"), F.col("depth").alias("pos"))
    return ins.join(at, (group == at["_g"]) & (down == at["_id"])).select("doc_id", "obj", F.col("op").alias("elem"), (F.col("pos") - n + 1).alias("pos"), *extra)


def text_width(s: Column, encoding: str = "codepoints") -> Column:
    """The width of a text value: ``codepoints``, ``utf8`` bytes or ``utf16`` units."""
    if encoding == "codepoints":
        return F.length(s)
    if encoding == "utf8":
        return F.octet_length(s)
    if encoding == "utf16":
        return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")
    raise ValueError(f"unknown encoding {encoding}")


def list_range(winners: DataFrame, order: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """Visible elements with their ``idx`` (from 0) in [low, high): ``winners`` columns and ``idx``."""
    seq = winners.where(F.col("elem").isNotNull()).join(order, ["doc_id", "obj", "elem"])
    at = F.row_number().over(Window.partitionBy("doc_id", "obj").orderBy("pos")).cast("bigint") - 1
    rows = seq.withColumn("idx", at).where(F.col("idx") >= low)
    return rows if high is None else rows.where(F.col("idx") < high)


def cursor_positions(winners: DataFrame, order: DataFrame) -> DataFrame:
    """``doc_id``, ``obj``, ``elem``, ``idx``, ``visible``: where a cursor on each element ever inserted points now.

    A deleted element's cursor moves after it: to the next visible element, else to the end.
    """
    live = winners.where(F.col("elem").isNotNull()).select("doc_id", "obj", "elem", F.lit(True).alias("visible"))
    w = Window.partitionBy("doc_id", "obj").orderBy("pos")
    before = F.coalesce(F.sum("_one").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = order.join(live, ["doc_id", "obj", "elem"], "left").withColumn("visible", F.coalesce("visible", F.lit(False)))
    return rows.withColumn("_one", F.col("visible").cast("bigint")).withColumn("idx", before).select("doc_id", "obj", "elem", "idx", "visible")


def cursor_positions_before(positions: DataFrame, ops: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """``doc_id``, ``obj``, ``elem``, ``idx``: cursors that move before a deleted element.

    They follow the chain of references from the element to the first visible one, else point at 0.
    """
    ins = log_ops(ops.where("is_insert")).select("doc_id", "obj", F.col("op").alias("elem"), "elem").toDF("doc_id", "obj", "elem", "ref")
    rows = positions.join(ins, ["doc_id", "obj", "elem"])
    group = F.concat_ws("/", F.col("doc_id").cast("string"), id_text("obj"))
    stop = F.col("visible") | (F.col("ref.ctr") == 0)
    nodes = rows.select(group.alias("g"), F.col("elem.ctr").alias("ord"), id_text("elem").alias("id"), F.when(~stop, id_text("ref")).alias("parent"))
    ends = forest(nodes, nodes.select("g", "ord"), max_nodes=max_nodes).select("g", "id", "root")
    shown = rows.select(group.alias("g"), id_text("elem").alias("root"), F.when(F.col("visible"), F.col("idx")).otherwise(0).alias("_idx"))
    return (
        rows.select(group.alias("g"), id_text("elem").alias("id"), "doc_id", "obj", "elem")
        .join(ends, ["g", "id"]).join(shown, ["g", "root"]).select("doc_id", "obj", "elem", F.col("_idx").alias("idx"))
    )
