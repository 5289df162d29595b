"""Graphs of parent links, closed block by block.

Nodes belong to groups (documents); links stay within a group.  Groups of ordinary size share
blocks by hash.  A group of more than ``max_nodes`` nodes is cut into blocks along the order of its
operation counters at approximate quantiles: parents have smaller counters than children, so most
links stay within a block and what crosses blocks is little.  Nodes with one counter that fill more than
a quantile are spread over the blocks of these by the hash of their id, so no block grows with its group.
Results don't depend on how groups are cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import graphs
from ..session import cut

MAX_NODES = 250_000
_GRID = 512


def assign(nodes: DataFrame, sizing: DataFrame, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame | None, int]:
    """Adds ``blk`` to ``nodes`` (``g``, ``ord``, ...): (those of ordinary groups, those of cut groups or None, number of blocks).

    ``sizing`` has a row (``g``, ``ord``) for each node or more; what is counted there decides.
    In cut groups ``blk_no`` numbers the blocks of the group from 0.
    """
    spark = nodes.sparkSession
    sizes = sizing.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > max_nodes)
    total, n_large = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > max_nodes)).first()
    buckets = max(2 * spark.sparkContext.defaultParallelism, int(total) // max(1, max_nodes // 4) + 1)
    by_hash = F.concat(F.lit("h"), F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("string"))
    if not n_large:
        return nodes.withColumn("blk", by_hash), None, buckets
    grid = [i / _GRID for i in range(1, _GRID)]
    splits = (
        sizing.join(large.select("g"), "g", "left_semi")
        .groupBy("g")
        .agg(F.percentile_approx("ord", grid, 8 * _GRID).alias("_splits"), F.count(F.lit(1)).alias("_n"))
    )
    splits = cut(splits)
    # a counter that fills m quantiles takes m + 1 places; groups that need more blocks than places cut each place by hash
    ties = F.size(F.filter("_splits", lambda s: s == F.col("ord")))
    rank = F.size(F.filter("_splits", lambda s: s < F.col("ord"))) + F.pmod(F.xxhash64("id"), ties + 1)
    parts = F.ceil(F.col("_n") / max_nodes) + 1
    deep = F.ceil(parts / _GRID)
    place = rank * deep + F.pmod(F.xxhash64("id", F.lit(1)), deep)
    # the table of cut groups has a row for every max_nodes nodes at most; AQE broadcasts it if it is small
    cut_nodes = (
        nodes.join(splits, "g")
        .withColumn("blk_no", F.floor(place * parts / (deep * _GRID)).cast("int"))
        .withColumn("blk", F.concat(F.lit("c"), F.col("g"), F.lit(":"), F.col("blk_no").cast("string")))
        .drop("_splits", "_n")
    )
    return nodes.join(splits.select("g"), "g", "left_anti").withColumn("blk", by_hash), cut_nodes, buckets


def crossing(cut_nodes: DataFrame) -> DataFrame:
    """Parents that lie in another block of their group than a child: ``g``, ``blk`` (the child's), ``id``."""
    links = cut_nodes.select("g", "blk", F.explode("parents").alias("id")).distinct()
    home = cut_nodes.select("g", "id", F.col("blk").alias("home"))
    return links.join(home, ["g", "id"]).where(F.col("home") != F.col("blk")).select("g", "blk", "id")


_FLAGS = "g string, id string, flag boolean"


def _close_block(pdf: pd.DataFrame, ext: pd.DataFrame | None, mode: str, carried: list[str]) -> pd.DataFrame:
    g, ids = pdf["g"].to_numpy(object), pdf["id"].to_numpy(object)
    n = len(ids)
    child, parent, flat = graphs.index_parents(g, ids, pdf["parents"].tolist())
    outside = np.zeros(n, dtype=bool)
    if ext is not None and len(ext):
        away = parent < 0
        at = graphs.find(ext["g"].to_numpy(object), ext["id"].to_numpy(object), g[child[away]], flat[away])
        flagged = ext["flag"].to_numpy(bool)[at]
        outside[child[away][(at >= 0) & (flagged if mode == "any" else ~flagged)]] = True
    child, parent = child[parent >= 0], parent[parent >= 0]
    if mode == "any":
        flag = graphs.reached(n, child, parent, pdf["seed"].to_numpy(bool) | outside)
    elif mode == "up":
        flag = graphs.reached(n, parent, child, pdf["seed"].to_numpy(bool))
    else:
        flag = graphs.grounded(n, child, parent, outside)
    return pd.DataFrame({"g": g, "id": ids, "flag": flag, **{c: pdf[c].to_numpy() for c in carried}})


def close(nodes: DataFrame, sizing: DataFrame, mode: str, max_nodes: int = MAX_NODES, carry: str = "") -> DataFrame:
    """``g``, ``id``, ``flag`` and the columns of the schema ``carry`` of every node; parents that aren't nodes of the group are ignored.

    ``nodes``: ``g`` string, ``ord`` bigint, ``id`` string (unique in ``g``), ``parents`` array<string>,
    and ``seed`` boolean for the modes ``any`` and ``up``.

    * ``any``: a node is flagged if it is a seed or a parent is flagged.
    * ``up``: a node is flagged if it is a seed or a child is flagged (seeds and their ancestors).
    * ``all``: a node is flagged if all its parents are; what stays without a flag lies on a cycle or
      below one.

    Ordinary groups take one pass.  Cut groups repeat it with the flags that crossed blocks in the
    pass before, until none is new; a pass settles every path within a block, however long.
    """
    whole, parts, n_blocks = assign(nodes, sizing, max_nodes)

    carried = [c.split()[0] for c in carry.split(", ") if c]
    flags = ", ".join(filter(None, (_FLAGS, carry)))

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        return _close_block(pdf, None, mode, carried)

    def with_ext(pdf: pd.DataFrame, ext: pd.DataFrame) -> pd.DataFrame:
        return _close_block(pdf, ext, mode, carried)

    used = [*dict.fromkeys(["g", "id", "parents", *([] if mode == "all" else ["seed"]), "blk", *carried])]
    out = whole.select(*used).repartition(n_blocks, "blk").groupBy("blk").applyInPandas(alone, flags)
    if parts is None:
        return out
    parts = cut(parts.select(*used))
    if mode == "up":
        return out.unionByName(_climb(parts, alone, flags))
    ext = cut(crossing(parts).toDF("g", "blk", "id"))
    waits = ext.select("g", "id").distinct()
    facts, known = waits.limit(0), 0
    while True:
        told = ext.join(facts.withColumn("flag", F.lit(True)), ["g", "id"], "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
        told = told.toDF(*told.columns)
        step = parts.groupBy("blk").cogroup(told.groupBy("blk")).applyInPandas(with_ext, flags)
        facts = cut(step.where("flag").join(waits, ["g", "id"], "left_semi").select("g", "id"))
        if (now := facts.count()) == known:
            return out.unionByName(step)
        known = now


def _climb(parts: DataFrame, alone, flags: str) -> DataFrame:
    """Mode ``up`` over cut groups: parents in other blocks become seeds of the next pass."""
    home = parts.select("g", "id", F.col("blk").alias("home"))
    links = parts.select("g", "blk", F.col("id").alias("child"), F.explode("parents").alias("id"))
    across = cut(links.join(home, ["g", "id"]).where(F.col("home") != F.col("blk")).select("g", "child", "id"))
    told, known = across.select("g", "id").limit(0), 0
    while True:
        seeded = parts.join(told.withColumn("_t", F.lit(True)), ["g", "id"], "left").withColumn("seed", F.col("seed") | F.col("_t").isNotNull())
        step = seeded.drop("_t").groupBy("blk").applyInPandas(alone, flags)
        up = step.where("flag").select("g", F.col("id").alias("child"))
        told = cut(across.join(up, ["g", "child"], "left_semi").select("g", "id").distinct())
        if (now := told.count()) == known:
            return step
        known = now


_LINKS = "g string, blk_no int, id string, parent string, root string, depth bigint, endless boolean"


def _contract_block(pdf: pd.DataFrame, with_path: bool) -> pd.DataFrame:
    """Links of one block united: each node with the parent, outside the block, of its local root."""
    g, ids, parent_ids = (pdf[c].to_numpy(object) for c in ("g", "id", "parent"))
    has = pd.notna(parent_ids)
    parent = np.full(len(ids), -1, dtype=np.int64)
    parent[has] = graphs.find(g, ids, g[has], parent_ids[has])
    weight = pdf["depth"].to_numpy(np.int64)
    root, off, endless = graphs.jump(parent, weight)
    endless |= pdf["endless"].to_numpy(bool)[root]
    depth = np.where(endless, -1, off + weight[root])
    out = pdf[["g", "blk_no", "id"]].copy()
    out["parent"] = np.where(endless, None, parent_ids[root])
    out["root"] = np.where(endless, None, pdf["root"].to_numpy(object)[root])
    out["depth"] = depth
    out["endless"] = endless
    if with_path:
        own = pdf["path"].tolist()
        path: list = [None] * len(ids)
        for i in np.argsort(depth, kind="stable"):
            if not endless[i]:
                path[i] = own[i] if parent[i] < 0 else np.concatenate([path[parent[i]], own[i]])
        out["path"] = path
    return out


def contract(links: DataFrame, n_blocks: int, with_path: bool, level: int = 0) -> DataFrame:
    """Weighted disjoint-set forests, merged level by level.

    ``links``: ``g``, ``blk``, ``blk_no``, ``id``, ``parent`` (null, or the parent's id; in cut groups a
    node of the group), ``root`` (the node's own id), ``depth`` (1), ``endless`` (false), and ``path``
    array<int> (the node's number) if wanted.  Each block unites its links; the nodes that other
    blocks point to are the nodes of the next level, where sixteen neighbouring blocks are one.
    Returns the same columns without ``blk``: ``root`` and ``depth`` (1 at roots) over all levels, or
    ``endless`` with null ``root``, ``path`` and depth -1 on and below cycles.
    """
    schema = _LINKS + (", path array<int>" if with_path else "")

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        return _contract_block(pdf, with_path)

    local = links.repartition(n_blocks, "blk").groupBy("blk").applyInPandas(unite, schema)
    if level < 0:
        return local
    local = cut(local)
    away = local.where(F.col("parent").isNotNull()).select("g", F.col("parent").alias("id")).distinct()
    if away.isEmpty():
        return local
    up = local.join(away, ["g", "id"], "left_semi").withColumn("blk_no", F.expr("blk_no div 16").cast("int"))
    up = up.withColumn("blk", F.concat("g", F.lit(":"), F.col("blk_no").cast("string")))
    over = contract(up, n_blocks, with_path, level + 1)
    over = over.select(
        "g", F.col("id").alias("parent"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("endless").alias("_endless"),
        *([F.col("path").alias("_path")] if with_path else []),
    )
    joined = local.join(over, ["g", "parent"], "left")
    bad = F.col("endless") | F.coalesce("_endless", F.lit(False))
    return joined.select(
        "g", "blk_no", "id",
        F.lit(None).cast("string").alias("parent"),
        F.when(~bad, F.coalesce("_root", "root")).alias("root"),
        F.when(bad, F.lit(-1)).otherwise(F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
        bad.alias("endless"),
        *([F.when(~bad, F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path"))).alias("path")] if with_path else []),
    )


def forest(
    nodes: DataFrame, sizing: DataFrame, with_path: bool = False, max_nodes: int = MAX_NODES, weight: str | None = None
) -> DataFrame:
    """Roots, depths, cycles (and paths) of nodes with at most one parent.

    ``nodes``: ``g``, ``ord``, ``id`` (unique in ``g``), ``parent`` (null, or a parent's id that need not exist).
    Returns ``g``, ``id``, ``root``, ``depth``, ``endless`` as :func:`contract` has them, and with paths
    ``node_no`` (numbered within ``g``) and ``path`` (the numbers from the root to the node).  ``weight``
    names a column that counts for ``depth`` instead of 1 (not together with paths).
    """
    whole, parts, n_blocks = assign(nodes, sizing, max_nodes)
    first = {
        "root": F.col("id"),
        "depth": (F.col(weight) if weight else F.lit(1)).cast("bigint"),
        "endless": F.lit(False),
    }
    cols = ["g", "blk", "blk_no", "id", "parent", *first]
    absent = F.lit(None).cast("string")

    def numbered(df: DataFrame) -> DataFrame:
        def number(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["g", "ord", "id"], kind="stable")
            return pdf.assign(no=pdf.groupby("g").cumcount().astype("int32") + 1)

        schema = "g string, ord bigint, id string, parent string, blk string, blk_no int, no int"
        return df.select("g", "ord", "id", "parent", "blk", "blk_no").repartition(n_blocks, "blk").groupBy("blk").applyInPandas(number, schema)

    whole = whole.withColumn("blk_no", F.lit(0))
    if with_path:
        whole = numbered(whole).withColumn("path", F.array("no"))
        cols = [*cols, "path"]
    out = contract(whole.withColumns(first).select(*cols), n_blocks, with_path, level=-1)
    # in ordinary groups a parent that isn't in the block is nowhere
    if parts is not None:
        if with_path:
            parts = cut(numbered(parts))
            before = Window.partitionBy("g").orderBy("blk_no").rowsBetween(Window.unboundedPreceding, -1)
            shift = parts.groupBy("g", "blk_no").agg(F.max("no").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)).cast("int"))
            parts = parts.join(shift.select("g", "blk_no", "_before"), ["g", "blk_no"]).withColumn("path", F.array(F.col("no") + F.col("_before")))
        parts = cut(parts.withColumns(first).select(*cols))
        known = parts.select("g", F.col("id").alias("parent"), F.lit(True).alias("_there"))
        linked = parts.join(known, ["g", "parent"], "left").withColumn("parent", F.when(F.col("_there"), F.col("parent")).otherwise(absent))
        out = out.unionByName(contract(linked.select(*cols), n_blocks, with_path))
    extra = [F.when(~F.col("endless"), F.element_at("path", -1)).alias("node_no"), "path"] if with_path else []
    return out.select("g", "id", "root", "depth", "endless", *extra)
