"""Merging histories: set union of changes and operations, idempotent and commutative."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import KEY, ready
from .state import get


def merge_changes(*histories: DataFrame) -> DataFrame:
    """The distinct changes of all histories (columns of the first); of equal hashes any copy, as hashes name contents."""
    cols = histories[0].columns
    rows = reduce(DataFrame.unionByName, [h.select(*cols) for h in histories])
    rest = [c for c in cols if c not in KEY]
    return rows.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("_r")).select(*KEY, "_r.*").select(*cols)


def merge_ops(*logs: DataFrame) -> DataFrame:
    """The distinct operations of all logs (columns of the first)."""
    cols = logs[0].columns
    rows = reduce(DataFrame.unionByName, [x.select(*cols) for x in logs])
    rest = [c for c in cols if c not in ("doc_id", "op")]
    return rows.groupBy("doc_id", "op").agg(F.min(F.struct(*rest)).alias("_r")).select("doc_id", "op", "_r.*").select(*cols)


def apply_changes(applied: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, waiting): the history with all incoming changes whose dependencies are met, and those held back."""
    fresh = merge_changes(incoming).join(applied.select(*KEY), KEY, "left_anti")
    state = ready(fresh, applied)
    go = fresh.join(state.where("ready").select(*KEY), KEY, "left_semi")
    return merge_changes(applied, go), fresh.join(state.where(~F.col("ready")).select(*KEY), KEY, "left_semi")


def same_documents(a: DataFrame, b: DataFrame) -> DataFrame:
    """``doc_id``, ``same``: whether two sets of visible operations hold the same values with the same conflicts."""
    x, y = (get(v).select("doc_id", "obj_id", "reg", "value", "conflict") for v in (a, b))
    odd = x.exceptAll(y).unionByName(y.exceptAll(x)).select("doc_id").distinct().withColumn("_odd", F.lit(True))
    docs = a.select("doc_id").unionByName(b.select("doc_id")).distinct()
    return docs.join(odd, "doc_id", "left").select("doc_id", F.col("_odd").isNull().alias("same"))
