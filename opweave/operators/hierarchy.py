"""Parent-child links to full hierarchies: roots, depths, paths, descendants and loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import ROOT, clean_changes, clean_op, id_text
from .blocks import MAX_NODES, assign, close, forest
from .delivery import with_hashes

_MAKES = (0, 2, 4, 6)


def object_links(ops: DataFrame, base: DataFrame) -> DataFrame:
    """``g`` (document), ``ord``, ``id``, ``parent`` of every object made by an operation or present before the log.

    Objects of the root have no parent.  An object made twice with different parents hangs on the
    least of them.
    """
    made = ops.where(F.col("op_action").isin(*_MAKES)).select("doc_id", "op", "obj")
    both = made.unionByName(base.select("doc_id", "op", "obj"))
    rows = both.groupBy("doc_id", clean_op("op").alias("op")).agg(F.min(clean_op("obj")).alias("obj"))
    up = id_text("obj")
    return rows.select(
        F.col("doc_id").cast("string").alias("g"),
        F.col("op.ctr").alias("ord"),
        id_text("op").alias("id"),
        F.when(up != ROOT, up).alias("parent"),
    )


def change_links(changes: DataFrame) -> DataFrame:
    """``g``, ``ord``, ``id`` (hash), ``parents`` of every change with a hash; copies give one row with all their deps.

    Copies without a hash count too, unless ``changes`` are distinct ones (without a ``delivery_id``).
    """
    deliveries = "delivery_id" in changes.columns
    used = ["doc_id", "hash", "start_op", "deps", *(["delivery_id", "actor", "seq"] if deliveries else [])]
    c = (with_hashes if deliveries else clean_changes)(changes.select(*used)).where(F.col("hash").isNotNull())
    return c.groupBy(F.col("doc_id").cast("string").alias("g"), F.col("hash").alias("id")).agg(
        F.min("start_op").alias("ord"), F.array_distinct(F.flatten(F.collect_set("deps"))).alias("parents")
    )


def _sizing(df: DataFrame, order: str) -> DataFrame:
    return df.select(F.col("doc_id").cast("string").alias("g"), F.col(order).alias("ord"))


def _object_sizing(ops: DataFrame, base: DataFrame) -> DataFrame:
    return _sizing(ops.where(F.col("op_action").isin(*_MAKES)), "op.ctr").unionByName(_sizing(base, "op.ctr"))


def on_loops(changes: DataFrame, ops: DataFrame, base: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """``node_kind``, ``doc_id``, ``node_id`` of the objects and changes that lie on a loop or have an ancestor on one.

    Objects have one parent: weighted disjoint-set forests, merged over blocks, tell which ways up
    never end.  Changes have several: in each block those with one parent are united with it in
    such a forest, and what remains is peeled from the roots.  Deps that aren't delivered changes of
    the document, and parents that were never made, are no links.
    """
    objects = forest(object_links(ops, base), _object_sizing(ops, base), max_nodes=max_nodes)
    of_changes = close(change_links(changes), _sizing(changes, "start_op"), "all", max_nodes)
    return (
        objects.where("endless")
        .select(F.lit("obj").alias("node_kind"), F.col("g").cast("bigint").alias("doc_id"), F.col("id").alias("node_id"))
        .unionByName(
            of_changes.where(~F.col("flag")).select(
                F.lit("change").alias("node_kind"), F.col("g").cast("bigint").alias("doc_id"), F.col("id").alias("node_id")
            )
        )
    )


def primary_parents(links: DataFrame) -> DataFrame:
    """Change links with one parent each: the least of the deps that are changes of the document."""
    edge = links.select("g", "id", F.explode("parents").alias("parent"))
    there = links.select("g", F.col("id").alias("parent"))
    least = edge.join(there, ["g", "parent"], "left_semi").groupBy("g", "id").agg(F.min("parent").alias("parent"))
    return links.select("g", "ord", "id").join(least, ["g", "id"], "left")


def hierarchy(links: DataFrame, sizing: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """The full forest of single-parent links.

    ``doc_id``, ``node_id``, ``node_no`` (numbered within the document), ``root_id``, ``depth`` (1 at roots),
    ``path`` (node numbers from the root to the node), ``n_descendants`` and ``on_loop``.  A node's
    descendants are the nodes whose ``path`` holds its number.  On and below loops ``node_no``,
    ``root_id``, ``path`` and ``n_descendants`` are null and ``depth`` is -1.  A node whose parent was never
    made is a root.
    """
    tree = forest(links, sizing, with_path=True, max_nodes=max_nodes)
    below = tree.select("g", F.explode("path").alias("node_no")).groupBy("g", "node_no").agg((F.count(F.lit(1)) - 1).alias("n_descendants"))
    return tree.join(below, ["g", "node_no"], "left").select(
        F.col("g").cast("bigint").alias("doc_id"),
        F.col("id").alias("node_id"),
        "node_no",
        F.col("root").alias("root_id"),
        "depth",
        "path",
        "n_descendants",
        F.col("endless").alias("on_loop"),
    )


def object_hierarchy(ops: DataFrame, base: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    return hierarchy(object_links(ops, base), _object_sizing(ops, base), max_nodes)


_LINEAGE = (
    "g string, id string, node_no int, root_ids array<string>, depth bigint, min_depth bigint, path array<int>, ancestors array<int>, n_descendants bigint, on_loop boolean"
)


def _lineage_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """All facts of :func:`change_hierarchy` for groups that lie in one block, by peeling from the roots."""
    pdf = pdf.sort_values(["g", "ord", "id"], kind="stable")
    groups: dict = {}
    for g, i, parents in zip(pdf["g"].tolist(), pdf["id"].tolist(), pdf["parents"].tolist()):
        groups.setdefault(g, {})[i] = parents
    rows = []
    for g, nodes in groups.items():
        ids = list(nodes)
        at = {i: k for k, i in enumerate(ids)}
        up = [sorted({p for p in ps if p in at}) if ps is not None else [] for ps in nodes.values()]
        up = [[at[p] for p in ps] for ps in up]
        down: list[list[int]] = [[] for _ in ids]
        for k, ps in enumerate(up):
            for p in ps:
                down[p].append(k)
        left = [len(ps) for ps in up]
        is_root = np.array([not n for n in left])
        far, near = [1] * len(ids), [1] * len(ids)
        above: list = [None] * len(ids)
        path: list = [None] * len(ids)
        below = np.zeros(len(ids), dtype=np.int64)
        ready = np.flatnonzero(is_root).tolist()
        while ready:
            k = ready.pop()
            ps = up[k]
            if ps:
                far[k], near[k] = 1 + max(far[p] for p in ps), 1 + min(near[p] for p in ps)
                above[k] = np.unique(np.concatenate([np.array(ps, dtype=np.int32), *(above[p] for p in ps)]))
                path[k] = np.append(path[ps[0]], np.int32(k + 1))
                below[above[k]] += 1
            else:
                above[k], path[k] = np.zeros(0, dtype=np.int32), np.array([k + 1], dtype=np.int32)
            for c in down[k]:
                left[c] -= 1
                if not left[c]:
                    ready.append(c)
        for k, i in enumerate(ids):
            if path[k] is None:
                rows.append((g, i, None, None, -1, -1, None, None, None, True))
            else:
                roots = [i] if is_root[k] else sorted(ids[a] for a in above[k][is_root[above[k]]])
                rows.append((g, i, k + 1, roots, far[k], near[k], path[k], above[k] + np.int32(1), int(below[k]), False))
    out = pd.DataFrame(rows, columns=["g", "id", "node_no", "root_ids", "depth", "min_depth", "path", "ancestors", "n_descendants", "on_loop"])
    return out.astype({"node_no": "Int32", "n_descendants": "Int64"})


def _lineage_apart(nodes: DataFrame, max_nodes: int) -> DataFrame:
    """The same for groups that are cut into blocks: pairs of node and ancestor, whose ways are doubled until none is new."""
    nodes = cut(nodes)
    sizing = nodes.select("g", "ord")
    tree = forest(primary_parents(nodes), sizing, with_path=True, max_nodes=max_nodes).select("g", "id", "node_no", "path")
    sound = cut(close(nodes, sizing, "all", max_nodes).where("flag").select("g", "id").join(tree, ["g", "id"]))
    links = nodes.join(sound.select("g", "id"), ["g", "id"], "left_semi").select("g", "id", F.explode("parents").alias("up"))
    there = sound.select("g", F.col("id").alias("up"))
    one = F.lit(1).cast("bigint")
    pairs = cut(links.join(there, ["g", "up"], "left_semi").distinct().select("g", "id", "up", one.alias("far"), one.alias("near")))
    facts = (F.count(one), F.sum("far"), F.sum("near"))
    known = pairs.agg(*facts).first()
    while True:
        on = pairs.select("g", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("far").alias("_far"), F.col("near").alias("_near"))
        longer = pairs.join(on, ["g", "up"]).select("g", "id", F.col("_up").alias("up"), (F.col("far") + F.col("_far")).alias("far"), (F.col("near") + F.col("_near")).alias("near"))
        pairs = cut(pairs.unionByName(longer).groupBy("g", "id", "up").agg(F.max("far").alias("far"), F.min("near").alias("near")))
        if (now := pairs.agg(*facts).first()) == known:
            break
        known = now
    lower = pairs.select("g", "id").distinct().withColumn("_lower", F.lit(True))
    ends = sound.join(lower, ["g", "id"], "left").select("g", F.col("id").alias("up"), F.col("node_no").alias("_no"), F.col("_lower").isNull().alias("_root"))
    above = pairs.join(ends, ["g", "up"]).groupBy("g", "id").agg(
        F.sort_array(F.collect_list(F.when(F.col("_root"), F.col("up")))).alias("root_ids"),
        (F.max("far") + 1).alias("depth"),
        (F.min(F.when(F.col("_root"), F.col("near"))) + 1).alias("min_depth"),
        F.sort_array(F.collect_list("_no")).alias("ancestors"),
    )
    below = pairs.groupBy("g", F.col("up").alias("id")).agg(F.count(one).alias("n_descendants"))
    facts_of = sound.join(above, ["g", "id"], "left").join(below, ["g", "id"], "left").select(
        "g", "id", "node_no",
        F.coalesce("root_ids", F.array("id")).alias("root_ids"),
        F.coalesce("depth", one).alias("depth"),
        F.coalesce("min_depth", one).alias("min_depth"),
        "path",
        F.coalesce("ancestors", F.array().cast("array<int>")).alias("ancestors"),
        F.coalesce("n_descendants", F.lit(0).cast("bigint")).alias("n_descendants"),
        F.lit(False).alias("on_loop"),
    )
    loops = nodes.select("g", "id").join(sound.select("g", "id"), ["g", "id"], "left_anti")
    nothing = {c: F.lit(None).cast(facts_of.schema[c].dataType) for c in ("node_no", "root_ids", "path", "ancestors", "n_descendants")}
    minus = F.lit(-1).cast("bigint")
    return facts_of.unionByName(loops.withColumns({**nothing, "depth": minus, "min_depth": minus, "on_loop": F.lit(True)}))


def change_hierarchy(changes: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """The hierarchy of changes over all their deps that are changes of the document.

    ``doc_id``, ``node_id``, ``node_no`` (numbered within the document), ``root_ids`` (every root that some way
    up ends at), ``depth`` and ``min_depth`` (the longest and the shortest way from a root, 1 at roots),
    ``path`` (node numbers of the one way over least deps), ``ancestors`` (the numbers of all ancestors),
    ``n_descendants`` and ``on_loop`` (as :func:`on_loops` has it).  A node's descendants are the nodes whose
    ``ancestors`` hold its number.  On and below loops the depths are -1 and the rest is null.
    """
    links, sizing = change_links(changes), _sizing(changes, "start_op")
    whole, parts, n_blocks = assign(links, sizing, max_nodes)
    used = ["g", "ord", "id", "parents"]
    out = whole.select(*used, "blk").repartition(n_blocks, "blk").groupBy("blk").applyInPandas(_lineage_block, _LINEAGE)
    if parts is not None:
        out = out.unionByName(_lineage_apart(parts.select(*used), max_nodes))
    rest = [c for c in out.columns if c not in ("g", "id")]
    return out.select(F.col("g").cast("bigint").alias("doc_id"), F.col("id").alias("node_id"), *rest)
