"""Whole-array graph steps for one block of a larger graph (numpy, no Spark)."""

from __future__ import annotations

import numpy as np
import pandas as pd


def index_parents(group: np.ndarray, ids: np.ndarray, parents: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a block: (child row, parent row or -1, flat parent ids). Ids are unique within a group."""
    n = len(ids)
    lengths = np.fromiter((len(p) if p is not None else 0 for p in parents), np.int64, n)
    child = np.repeat(np.arange(n), lengths)
    flat = np.concatenate([p for p in parents if p is not None and len(p)]) if lengths.sum() else np.zeros(0, object)
    return child, find(group, ids, group[child], flat), flat


def find(group: np.ndarray, ids: np.ndarray, of_group: np.ndarray, of_ids: np.ndarray) -> np.ndarray:
    """The row of each (of_group, of_ids) among (group, ids), or -1."""
    if not len(of_ids) or not len(ids):
        return np.full(len(of_ids), -1, dtype=np.int64)
    g, _ = pd.factorize(np.concatenate([group, of_group]))
    i, names = pd.factorize(np.concatenate([ids, of_ids]))
    key = g.astype(np.int64) * (len(names) + 1) + i
    where = pd.Index(key[: len(ids)])
    wanted = key[len(ids) :]
    if where.is_unique:
        return where.get_indexer(wanted)
    first = ~where.duplicated()
    at = where[first].get_indexer(wanted)
    return np.where(at >= 0, np.flatnonzero(first)[at], -1)


def jump(parent: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted disjoint-set forest with all paths compressed.

    ``parent`` is -1 at roots.  Returns each node's root, the sum of ``weight`` along the way to it
    (the root's own excluded) and whether the way never ends: the node is on a cycle or below one.
    Compression doubles the stretch in each step, so a chain of a million takes twenty.
    """
    n = len(parent)
    me = np.arange(n)
    up = np.where(parent < 0, me, parent)
    off = np.where(parent < 0, 0, weight)
    for _ in range(max(1, int(n).bit_length())):
        off = off + off[up]
        up = up[up]
    return up, off, parent[up] >= 0


def _below(frontier: np.ndarray, start: np.ndarray, adjacent: np.ndarray) -> np.ndarray:
    """All entries of the adjacency lists of ``frontier``."""
    counts = start[frontier + 1] - start[frontier]
    total = int(counts.sum())
    if not total:
        return adjacent[:0]
    ends = np.cumsum(counts)
    return adjacent[np.arange(total) + np.repeat(start[frontier] - (ends - counts), counts)]


def _children(n: int, child: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(parent, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=n))]), child[order]


def reached(n: int, child: np.ndarray, parent: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which nodes are seeds or have one among their ancestors."""
    start, down = _children(n, child, parent)
    seen = seeds.copy()
    frontier = np.flatnonzero(seeds)
    while len(frontier):
        nxt = np.unique(_below(frontier, start, down))
        frontier = nxt[~seen[nxt]]
        seen[frontier] = True
    return seen


def grounded(n: int, child: np.ndarray, parent: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which nodes have only ancestors that end at roots; ``held`` nodes have a parent elsewhere that isn't known to be so.

    Nodes with a single parent are united with it first (weighted forest), which leaves a graph of
    the nodes with several parents; that is peeled from the roots.
    """
    degree = np.bincount(child, minlength=n)
    up = np.full(n, -1, dtype=np.int64)
    lone = (degree[child] == 1) & ~held[child]
    up[child[lone]] = parent[lone]
    root, _, endless = jump(up, np.ones(n, dtype=np.int64))
    c, p = child[~lone], parent[~lone]
    p_bad, p = endless[p], root[p]
    left = np.bincount(c, minlength=n) + held * (n + 1)
    np.add.at(left, c[p_bad], n + 1)
    start, down = _children(n, c[~p_bad], p[~p_bad])
    heads = np.flatnonzero((up < 0) & (left == 0))
    ok = np.zeros(n, dtype=bool)
    while len(heads):
        ok[heads] = True
        nxt, times = np.unique(_below(heads, start, down), return_counts=True)
        left[nxt] -= times
        heads = nxt[left[nxt] == 0]
    return ok[root] & ~endless
