"""Documents as trees of values: JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ROOT, id_text
from .state import MAKE_LIST, MAKE_MAP, MAKE_TABLE, MAKE_TEXT, winners

_MAKES = (MAKE_MAP, MAKE_LIST, MAKE_TEXT, MAKE_TABLE)


def _json(c: Column) -> Column:
    """A value as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":([\s\S]*)\}$", 1)


def scalar_json(v: Column, n: Column) -> Column:
    """A scalar as JSON: bytes as an array of numbers, counters and timestamps as numbers."""
    byte = F.transform(F.sequence(F.lit(1), F.length(v["b"])), lambda i: F.conv(F.hex(F.substring(v["b"], i, F.lit(1))), 16, 10))
    return (
        F.when(n.isNotNull(), n.cast("string"))
        .when(v["tag"] == "str", _json(v["s"]))
        .when((v["tag"] == "bytes") & (F.length(v["b"]) > 0), F.concat(F.lit("["), F.array_join(byte, ","), F.lit("]")))
        .when(v["tag"] == "bytes", F.lit("[]"))
        .when(v["tag"] == "bool", v["flag"].cast("string"))
        .when(v["tag"] == "f64", _json(v["d"]))
        .when(v["tag"] == "uint", v["u"].cast("string"))
        .when(v["tag"].isin("int", "timestamp"), v["i"].cast("string"))
        .otherwise(F.lit("null"))
    )


def _tree(pdf: pd.DataFrame) -> pd.DataFrame:
    """The JSON of one document from its entries, without recursion."""
    entries: dict[str, list] = {}
    for r in pdf.sort_values(["pos", "label"], kind="stable").itertuples(index=False):
        entries.setdefault(r.obj, []).append(r)
    done: dict[str, str] = {}
    open_: set[str] = set()
    stack: list[tuple[str, int, str | None]] = [(ROOT, MAKE_MAP, None)]
    while stack:
        obj, action, text = stack[-1]
        rows = entries.get(obj, ())
        if obj not in open_:
            open_.add(obj)
            if action == MAKE_TEXT:
                done[obj] = text or '""'
                stack.pop()
                continue
            below = [(r.child, int(r.action), r.text) for r in rows if r.child is not None and r.child not in open_]
            stack.extend(below)
            if below:
                continue
        if obj not in done:
            parts = []
            for r in rows:
                value = r.json if r.child is None else done.get(r.child)
                if value is not None:
                    parts.append(value if action == MAKE_LIST else f"{r.label}:{value}")
            done[obj] = ("[%s]" if action == MAKE_LIST else "{%s}") % ",".join(parts)
        stack.pop()
    return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "json": [done[ROOT]]})


def documents_json(visible: DataFrame, order: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id``, ``json`` of every document: maps as objects with sorted keys, lists as arrays, texts as strings.

    Scalars, keys and texts are written as JSON by Spark; a document is put together in one task,
    as its result is one value.  Objects that hang on nothing or in a loop aren't part of it.
    """
    w = winners(visible)
    made = F.col("op_action").isin(*_MAKES)
    t = texts.select("doc_id", F.col("obj_id").alias("child"), _json(F.col("text")).alias("text"))
    rows = (
        w.join(order, ["doc_id", "obj", "elem"], "left")
        .where(F.col("elem").isNull() | F.col("pos").isNotNull())
        .select(
            "doc_id", id_text("obj").alias("obj"), F.coalesce("pos", F.lit(0)).alias("pos"), _json(F.col("reg")).alias("label"),
            F.when(made, id_text("op")).alias("child"), F.col("op_action").cast("int").alias("action"),
            F.when(~made, scalar_json(F.col("val"), F.col("n"))).alias("json"),
        )
        .join(t, ["doc_id", "child"], "left")
    )
    return rows.groupBy("doc_id").applyInPandas(_tree, "doc_id bigint, json string")
