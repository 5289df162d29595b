"""Spans, rollback, transactions that fail, and writing beside later changes."""

from __future__ import annotations

import copy
import random

import pytest

from opweave.plans.transaction import ROOT_ID, Scalar, Snapshot, Transaction, isolated, transact

A, B = "aa" * 4, "bb" * 4


def _text(content=""):
    t = Transaction(Snapshot(), A)
    obj = t.put_object(ROOT_ID, "text", "text")
    t.splice_text(obj, 0, 0, content)
    return t, obj


def _normal(spans):
    out = []
    for s in spans:
        if "block" in s:
            out.append(s)
        elif s["text"]:
            marks = {k: v for k, v in s.get("marks", {}).items() if v is not None}
            if out and out[-1].get("marks") == marks:
                out[-1] = {"text": out[-1]["text"] + s["text"], "marks": marks}
            else:
                out.append({"text": s["text"], "marks": marks})
    return out


def test_marks_and_spans():
    t, obj = _text("hello world")
    t.mark(obj, 0, 5, "bold", True)
    t.mark(obj, 3, 8, "link", "x")
    t.mark(obj, 4, 6, "bold", None)
    t.split_block(obj, 5)
    want = [
        {"text": "hel", "marks": {"bold": True}}, {"text": "l", "marks": {"bold": True, "link": "x"}}, {"text": "o", "marks": {"link": "x"}},
        {"block": {}}, {"text": " wo", "marks": {"link": "x"}}, {"text": "rld", "marks": {}},
    ]
    assert t.doc.spans(obj) == want
    assert Snapshot.of_changes([t.commit()]).spans(obj) == want


def test_blocks_are_updated_in_place():
    t, obj = _text("ab")
    block = t.split_block(obj, 0)
    t.update_object(block, {"type": "item", "parents": ["div"]})
    t.update_spans(obj, [{"block": {"type": "item", "parents": []}}, {"text": "ab"}])
    assert t.doc.spans(obj) == [{"block": {"type": "item", "parents": []}}, {"text": "ab", "marks": {}}]
    assert t.doc.object(obj, 0) == block
    n = t.pending_ops()
    t.update_spans(obj, t.doc.spans(obj))
    assert t.pending_ops() == n


@pytest.mark.parametrize("seed", range(25))
def test_spans_become_what_is_wanted(seed):
    r = random.Random(seed)

    def spans():
        out = []
        for _ in range(r.randint(0, 5)):
            if r.random() < 0.3:
                out.append({"block": {"type": r.choice("pq"), "parents": r.choice([[], ["div"]])}})
            else:
                marks = {n: r.choice([True, "x", 3]) for n in r.sample(["bold", "link"], r.randint(0, 2))}
                out.append({"text": "".join(r.choice("abc é👍🏽") for _ in range(r.randint(1, 6))), "marks": marks})
        return _normal(out)

    t, obj = _text()
    for _ in range(4):
        want = spans()
        t.update_spans(obj, want, expand=r.choice(["none", "after", "both"]))
        assert t.doc.spans(obj) == want


def _facts(s: Snapshot):
    slots = {k: [(o.id, o.tag, o.value) for o in v] for k, v in s.registers.items() if v}
    order = {k: v for k, v in s.order.items() if v}
    return copy.deepcopy((slots, order, s.types, set(s.marks), s.references, s.heads, s.max_op, s.seqs))


def test_rollback_leaves_nothing():
    t, obj = _text("some text")
    t.put(ROOT_ID, "n", Scalar("counter", 2))
    items = t.put_object(ROOT_ID, "items", "list")
    t.insert(items, 0, 1)
    doc = Snapshot.of_changes([t.commit()])
    before = _facts(doc)
    u = Transaction(doc, B)
    u.increment(ROOT_ID, "n", 5)
    u.splice_text(obj, 2, 3, "new")
    u.mark(obj, 0, 4, "bold", True)
    u.update_object(u.split_block(obj, 1), {"a": [1, {"b": 2}]})
    u.put(items, 0, "x")
    u.delete(ROOT_ID, "items")
    assert u.rollback() > 10 and u.pending_ops() == 0 and _facts(doc) == before
    assert u.commit() is None
    with pytest.raises(ZeroDivisionError):
        transact(doc, B, lambda v: (v.put(ROOT_ID, "k", 1), 1 / 0))
    assert _facts(doc) == before
    change, result = transact(doc, B, lambda v: v.put_object(ROOT_ID, "m", "map"), 7, "made")
    assert (change.time, change.message, change.seq) == (7, "made", 1) and doc.type_of(result) == "map"


def test_writing_beside_later_changes(spark):
    schema = "doc_id bigint, hash string, actor string, seq bigint, start_op bigint, max_op bigint, deps array<string>"
    rows = [(1, "h1", A, 1, 1, 1, []), (1, "h2", A, 2, 2, 3, ["h1"]), (1, "h3", B, 1, 4, 4, ["h2"])]
    one = lambda i, a, key: (1, (i, a), (0, ""), key, None, False, 1, ("int", i, None, None, None, None, None), None, False, [], "h")
    ops = spark.createDataFrame(
        [one(1, A, "a"), one(2, A, "b"), one(3, A, "c"), one(4, B, "d")],
        "doc_id bigint, op struct<ctr:bigint,actor:string>, obj struct<ctr:bigint,actor:string>, op_key string, elem struct<ctr:bigint,actor:string>, is_insert boolean, op_action tinyint, "
        "val struct<tag:string,i:bigint,u:decimal(20,0),d:double,s:string,b:binary,flag:boolean>, mark_name string, expand boolean, pred array<struct<ctr:bigint,actor:string>>, change_hash string",
    )
    changes = spark.createDataFrame(rows, schema)
    version = spark.createDataFrame([(1, "h1")], "doc_id bigint, hash string")
    t = isolated(changes, ops, 1, version, A)
    assert t.actor == "13b22309" + "01" + A and t.start == 5 and t.deps == ["h1"] and t.doc.keys(ROOT_ID) == ["a"]
    assert isolated(changes, ops, 1, version, "cc").actor == "cc"
    taken = changes.union(spark.createDataFrame([(1, "h4", t.actor, 1, 5, 5, ["h1"])], schema))
    assert isolated(taken, ops, 1, version, A).actor == "13b22309" + "02" + A
    now = spark.createDataFrame([(1, "h3")], "doc_id bigint, hash string")
    assert isolated(changes, ops, 1, now, A).actor == A
