"""The hierarchy of changes over all deps, in whole and in cut groups, against brute force."""

from __future__ import annotations

import random

import pytest

from opweave.operators import hierarchy

CHANGES = "doc_id bigint, hash string, start_op bigint, deps array<string>"


def histories(seed=3):
    r = random.Random(seed)
    rows = []
    for doc, n in ((1, 60), (2, 9)):
        for i in range(n):
            deps = [f"{doc}-{j}" for j in {r.randint(max(0, i - 6), i - 1) for _ in range(r.choice([0, 1, 2, 3]))}] if i else []
            rows.append([doc, f"{doc}-{i}", i, deps + (["gone"] if r.random() < 0.1 else [])])
    rows += [[3, "a", 1, ["b"]], [3, "b", 2, ["a"]], [3, "0", 0, []], [3, "c", 3, ["0", "b"]], [3, "d", 4, ["c"]], [3, "e", 5, ["0"]]]
    return rows


@pytest.mark.parametrize("max_nodes", [20, 1000])
def test_all_deps_count(spark, max_nodes):
    rows = histories()
    up = {(g, h): [(g, d) for d in deps if any(x[0] == g and x[1] == d for x in rows)] for g, h, _, deps in rows}

    def ways(k, seen=()):
        """All (length, root) upwards, or None where one never ends."""
        if k in seen:
            return None
        if not up[k]:
            return {(1, k[1])}
        found = [ways(p, (*seen, k)) for p in up[k]]
        return None if any(f is None for f in found) else {(n + 1, root) for f in found for n, root in f}

    def above(k):
        found, todo = set(), list(up[k])
        while todo:
            if (p := todo.pop()) not in found:
                found.add(p)
                todo += up[p]
        return found

    df = spark.createDataFrame(rows, CHANGES)
    got = {(x.doc_id, x.node_id): x for x in hierarchy.change_hierarchy(df, max_nodes).collect()}
    assert set(got) == set(up)
    for k, x in got.items():
        w = ways(k)
        if w is None:
            assert x.on_loop and x.depth == x.min_depth == -1
            assert x.node_no is x.root_ids is x.path is x.ancestors is x.n_descendants is None
            continue
        least = [k]
        while up[least[-1]]:
            least.append(min(up[least[-1]]))
        assert not x.on_loop and x.root_ids == sorted({r for _, r in w})
        assert (x.depth, x.min_depth) == (max(n for n, _ in w), min(n for n, _ in w))
        assert x.path == [got[p].node_no for p in reversed(least)]
        assert x.ancestors == sorted(got[p].node_no for p in above(k))
        assert x.n_descendants == sum(k in above(c) for c in up if ways(c) is not None)
    assert {k[1] for k, x in got.items() if x.on_loop} == {"a", "b", "c", "d"}
