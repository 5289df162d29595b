"""Text, marks and spans of text objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import id_text
from .graph import covered_ops
from .sequence import text_width
from .state import MAKE_MAP, MAKE_TEXT, MARK, log_ops, value_text

OBJECT_MARK = "￼"


def text_objects(ops: DataFrame) -> DataFrame:
    """``doc_id``, ``obj`` of every text ever made."""
    return ops.where(F.col("op_action") == MAKE_TEXT).select("doc_id", F.col("op").alias("obj")).distinct()


def text_items(ops: DataFrame, visible: DataFrame, order: DataFrame, encoding: str = "codepoints") -> DataFrame:
    """Every visible member of every text element: ``doc_id``, ``obj``, ``elem``, ``pos``, ``op``, ``s``, ``block_id``, ``start``, ``width``.

    Members of one element that conflict are all there, in order of their ids.  What isn't a string
    is an object mark; a map in a text is a block.  ``start`` counts the widths before.  With pieces of a log in runs and
    their order, a piece is one item, with ``run_n`` and ``run``, in code points and without ``s`` until :func:`.runs.fill`.
    """
    extra = [c for c in ("run_n", "run") if c in order.columns]
    if extra and encoding != "codepoints":
        raise ValueError("items of runs count code points")
    s = F.when(F.col("val.tag") == "str", F.col("val.s")).otherwise(F.lit(OBJECT_MARK))
    rows = (
        visible.where(F.col("elem").isNotNull())
        .join(text_objects(ops), ["doc_id", "obj"], "left_semi")
        .join(order, ["doc_id", "obj", "elem"])
        .select("doc_id", "obj", "elem", "pos", "op", s.alias("s"), F.when(F.col("op_action") == MAKE_MAP, id_text("op")).alias("block_id"), *extra)
        .withColumn("width", F.coalesce(text_width(F.col("s"), encoding), F.col("run_n") if extra else F.lit(None)).cast("bigint"))
    )
    w = Window.partitionBy("doc_id", "obj").orderBy("pos", "op").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("width").over(w), F.lit(0)))


def texts(items: DataFrame) -> DataFrame:
    """``doc_id``, ``obj_id``, ``text`` and its ``length`` in the encoding of ``items``, of every text with visible content."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "op", "s")))
    return items.groupBy("doc_id", "obj").agg(
        F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("text"), F.sum("width").alias("length")
    ).select("doc_id", id_text("obj").alias("obj_id"), "text", "length")


def mark_intervals(ops: DataFrame, order: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``obj``, ``name``, ``value`` (null: unmarked), ``op``, and the places ``from_pos`` < ``to_pos`` of a mark's ends.

    A begin has the mark's name; its end is the operation of the next counter by the same actor.  A
    mark without an end reaches to the end of the text.
    """
    o = log_ops(ops.where(F.col("op_action") == MARK) if clock is None else covered_ops(ops.where(F.col("op_action") == MARK), clock))
    places = order.select("doc_id", "obj", F.col("elem").alias("op"), "pos")
    at = o.join(places, ["doc_id", "obj", "op"]).select("doc_id", "obj", "op", "mark_name", "val", "pos")
    begin = at.where(F.col("mark_name").isNotNull()).select("doc_id", "obj", "op", F.col("mark_name").alias("name"), value_text(F.col("val")).alias("value"), F.col("pos").alias("from_pos"))
    end = at.where(F.col("mark_name").isNull()).select("doc_id", "obj", F.struct((F.col("op.ctr") - 1).alias("ctr"), F.col("op.actor").alias("actor")).alias("op"), F.col("pos").alias("to_pos"))
    return begin.join(end, ["doc_id", "obj", "op"], "left").withColumn("to_pos", F.coalesce("to_pos", F.lit((1 << 62)).cast("bigint")))


def item_marks(items: DataFrame, intervals: DataFrame) -> DataFrame:
    """The marks in force on each item: ``items`` columns with ``name``, ``value``; of several of a name the greatest id holds."""
    hit = items.join(intervals.select("doc_id", "obj", F.col("op").alias("_m"), "name", "value", "from_pos", "to_pos"), ["doc_id", "obj"])
    hit = hit.where((F.col("pos") > F.col("from_pos")) & (F.col("pos") < F.col("to_pos")))
    won = hit.groupBy("doc_id", "obj", "pos", "op", "start", "width", "name").agg(F.max_by("value", "_m").alias("value"))
    return won.where(F.col("value").isNotNull())


def marks(items: DataFrame, intervals: DataFrame) -> DataFrame:
    """``doc_id``, ``obj_id``, ``name``, ``value``, ``start``, ``end``: consolidated ranges of every mark."""
    m = item_marks(items, intervals)
    w = Window.partitionBy("doc_id", "obj", "name").orderBy("start", "pos", "op")
    fresh = ~((F.lag(F.col("start") + F.col("width")).over(w) == F.col("start")) & F.lag("value").over(w).eqNullSafe(F.col("value")))
    runs = m.withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("doc_id", "obj", "name", "value", "_run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("width")).alias("end")
    ).select("doc_id", id_text("obj").alias("obj_id"), "name", "value", "start", "end")


def spans(items: DataFrame, intervals: DataFrame, fill: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``doc_id``, ``obj_id``, ``span_no`` (from 1), ``text``, ``marks`` (``name=value``, sorted), ``block_id``.

    Runs of items with the same marks; a block is a span of its own, without text.  ``fill`` gives numbered items their
    texts, if they have none yet.
    """
    m = item_marks(items, intervals).groupBy("doc_id", "obj", "pos", "op").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "name", "value"))), ",").alias("marks")
    )
    rows = items.join(m, ["doc_id", "obj", "pos", "op"], "left").withColumn("marks", F.coalesce("marks", F.lit("")))
    w = Window.partitionBy("doc_id", "obj").orderBy("pos", "op")
    block = F.col("block_id").isNotNull() | F.lag("block_id").over(w).isNotNull()
    fresh = (F.coalesce(F.lag("marks").over(w) != F.col("marks"), F.lit(True)) | block).cast("int")
    numbered = rows.withColumn("_new", fresh).withColumn("span_no", F.sum("_new").over(w))
    numbered = fill(numbered) if fill else numbered
    parts = F.array_sort(F.collect_list(F.struct("pos", "op", "s")))
    text = F.when(F.col("block_id").isNull(), F.array_join(F.transform(parts, lambda p: p["s"]), ""))
    return numbered.groupBy("doc_id", "obj", "span_no", "marks", "block_id").agg(text.alias("text")).select(
        "doc_id", id_text("obj").alias("obj_id"), "span_no", "text", "marks", "block_id"
    )


def marks_at(items: DataFrame, intervals: DataFrame, index: int) -> DataFrame:
    """``doc_id``, ``obj_id``, ``name``, ``value``: the marks in force at a place of each text (in the widths of ``items``)."""
    here = items.where((F.col("start") <= index) & (F.col("start") + F.col("width") > index))
    return item_marks(here, intervals).select("doc_id", id_text("obj").alias("obj_id"), "name", "value")
