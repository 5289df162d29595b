"""Graphs in blocks: every operator with blocks so small that groups are cut, against brute force."""

from __future__ import annotations

import random

import pytest

from opweave.operators import blocks, graph, hierarchy, sequence

NODES = "g string, ord bigint, id string, parents array<string>, seed boolean"


def random_graph(seed, n=120, loops=3):
    r = random.Random(seed)
    rows = []
    for g in ("1", "2"):
        for i in range(n if g == "1" else 15):
            ps = {str(r.randint(max(0, i - 9), i - 1)) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))} if i else set()
            if r.random() < 0.05:
                ps.add(f"missing{i}")
            rows.append([g, i, str(i), sorted(ps), r.random() < 0.04])
        for _ in range(loops if g == "1" else 0):
            a, b = sorted(r.sample(range(n), 2))
            rows[a][3] = sorted({*rows[a][3], str(b)})
    return rows


def brute(rows, mode):
    flags, links = {}, {}
    for g, _, i, ps, seed in rows:
        links[(g, i)] = [(g, p) for p in ps if any(x[0] == g and x[2] == p for x in rows)]
        flags[(g, i)] = seed and mode != "all"
    grew = True
    while grew:
        grew = False
        for k, ps in links.items():
            now = flags[k]
            if mode == "any":
                now = now or any(flags[p] for p in ps)
            elif mode == "all":
                now = now or all(flags[p] for p in ps)
            else:
                for p in ps:
                    if flags[k] and not flags[p]:
                        flags[p] = grew = True
            grew |= now != flags[k]
            flags[k] = now
    return {k for k, v in flags.items() if v}


@pytest.mark.parametrize("mode", ["any", "all", "up"])
@pytest.mark.parametrize("max_nodes", [20, 1000])
def test_close(spark, mode, max_nodes):
    rows = random_graph(len(mode) + max_nodes)
    df = spark.createDataFrame(rows, NODES)
    got = {(r.g, r.id) for r in blocks.close(df, df.select("g", "ord"), mode, max_nodes).where("flag").collect()}
    assert got == brute(rows, mode)


@pytest.mark.parametrize("max_nodes", [5, 1000])
def test_forest(spark, max_nodes):
    r = random.Random(max_nodes)
    rows = [("1", i, str(i), str(r.randint(max(0, i - 4), i - 1)) if i and r.random() < 0.9 else None) for i in range(90)]
    rows[10] = ("1", 10, "10", "40")
    rows[40] = ("1", 40, "40", "10")
    rows[50] = ("1", 50, "50", "nowhere")
    rows += [("2", 0, "0", None), ("2", 1, "1", "0"), ("3", 0, "0", "0")]
    df = spark.createDataFrame(rows, "g string, ord bigint, id string, parent string")
    got = {(x.g, x.id): x for x in blocks.forest(df, df.select("g", "ord"), with_path=True, max_nodes=max_nodes).collect()}
    up = {(g, i): p for g, _, i, p in rows}
    number = {(x.g, x.id): x.node_no for x in got.values()}
    assert len(got) == len(rows)
    for (g, i), x in got.items():
        way = [i]
        while up[(g, way[-1])] is not None and (g, up[(g, way[-1])]) in up and len(way) < 200:
            way.append(up[(g, way[-1])])
        if len(way) == 200:
            assert x.endless and x.root is None and x.depth == -1 and x.path is None
        else:
            assert not x.endless and x.root == way[-1] and x.depth == len(way)
            assert x.path == [number[(g, w)] for w in reversed(way)]
    assert len({n for k, n in number.items() if n is not None}) <= len(rows)


CHANGES = "doc_id bigint, hash string, actor string, seq bigint, start_op bigint, max_op bigint, deps array<string>"


def change_rows():
    return [
        (1, "a", "x", 1, 1, 2, []), (1, "b", "x", 2, 3, 4, ["a"]), (1, "c", "y", 1, 3, 3, ["a"]), (1, "d", "x", 3, 5, 6, ["b", "c"]),
        (1, "e", "y", 2, 7, 7, ["d", "z"]), (1, "l1", "w", 1, 1, 1, ["l2"]), (1, "l2", "w", 2, 2, 2, ["l1"]), (2, "a", "x", 1, 1, 1, []),
    ]


@pytest.mark.parametrize("max_nodes", [2, 1000])
def test_change_graph(spark, max_nodes):
    c = spark.createDataFrame(change_rows(), CHANGES)
    v = spark.createDataFrame([(1, "b"), (1, "unknown")], "doc_id bigint, hash string")
    assert {tuple(r) for r in graph.heads(c).collect()} == {(1, "e"), (2, "a")}
    assert {r.hash for r in graph.ancestors(c, v, max_nodes).collect()} == {"a", "b"}
    assert {tuple(r) for r in graph.clock(c, v, max_nodes).collect()} == {(1, "x", 4, 2)}
    assert {r.hash for r in graph.changes_since(c, v).collect() if r.doc_id == 1} == {"c", "d", "e", "l1", "l2"}
    assert {tuple(r) for r in graph.missing_deps(c).collect()} == {(1, "z")}
    assert {r.hash for r in graph.ready(c, None, max_nodes).where("ready").collect() if r.doc_id == 1} == {"a", "b", "c", "d"}
    z = spark.createDataFrame([(1, "z")], "doc_id bigint, hash string")
    assert {r.hash for r in graph.ready(c, z, max_nodes).where("ready AND doc_id = 1").collect()} == {"a", "b", "c", "d", "e"}
    with pytest.raises(ValueError, match="InvalidHash"):
        graph.fork(c, spark.createDataFrame([], "doc_id bigint, change_hash string"), v)


def test_on_loops_of_nothing(spark):
    c = spark.createDataFrame([], CHANGES)
    ident = "struct<ctr:bigint,actor:string>"
    o = spark.createDataFrame([], f"doc_id bigint, op {ident}, obj {ident}, op_action tinyint")
    assert hierarchy.on_loops(c, o, o.drop("op_action")).count() == 0
    made = spark.createDataFrame([(1, (1, "a"), (2, "a"), 0), (1, (2, "a"), (1, "a"), 2), (1, (3, "a"), (2, "a"), 4), (1, (4, "a"), (0, ""), 0), (None, (1, "a"), (0, ""), 0)], f"doc_id bigint, op {ident}, obj {ident}, op_action tinyint")
    got = hierarchy.on_loops(spark.createDataFrame(change_rows(), CHANGES), made, o.drop("op_action")).collect()
    assert {tuple(r) for r in got} == {("obj", 1, "1@a"), ("obj", 1, "2@a"), ("obj", 1, "3@a"), ("change", 1, "l1"), ("change", 1, "l2")}


@pytest.mark.parametrize("max_nodes", [6, 1000])
def test_element_order(spark, max_nodes):
    r = random.Random(4)
    rows, ids = [], []
    for c in range(2, 60):
        i = (c, r.choice("ab"))
        ref = r.choice([(0, ""), *ids[-3:]]) if ids else (0, "")
        rows.append((1, i, (1, "a"), None, ref, True, 1))
        ids.append(i)
    rows.append((1, (70, "a"), (1, "a"), None, (99, "q"), True, 1))
    schema = (
        "doc_id bigint, op struct<ctr:bigint,actor:string>, obj struct<ctr:bigint,actor:string>, op_key string, elem struct<ctr:bigint,actor:string>, is_insert boolean, op_action int, "
        "val string, mark_name string, expand boolean, pred array<string>"
    )
    df = spark.createDataFrame([(*x, None, None, None, None) for x in rows], schema)
    got = [tuple(x.elem) for x in sequence.element_order(df, max_nodes).orderBy("pos").collect()]
    want: list = []
    for x in sorted(rows[:-1], key=lambda x: x[1]):
        at = want.index(x[4]) + 1 if x[4] != (0, "") else 0
        while at < len(want) and want[at] > x[1]:
            at += 1
        want.insert(at, x[1])
    assert got == want


def test_no_block_grows_with_its_group(spark):
    """Many nodes with one counter, and groups that need more blocks than there are quantiles."""
    for n in (3000, 12_000):
        rows = [("g", 7 if i % 3 else i, f"n{i}") for i in range(n)] + [("small", 1, "x")]
        df = spark.createDataFrame(rows, "g string, ord bigint, id string")
        whole, parts, _ = blocks.assign(df, df.select("g", "ord"), max_nodes=8 if n < 5000 else 100)
        largest = max(r["count"] for r in parts.groupBy("blk").count().collect())
        assert whole.count() == 1 and parts.count() == n and largest <= (8 * 6 if n < 5000 else 100 * 3)
