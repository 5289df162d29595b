"""Deduplication, heavy keys, current entries, orphans, sessions: edge cases and brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opweave.operators import delivery, feed, orphans, sessions, skew
from opweave.sources.tables import clean_id

CHANGES = "delivery_id bigint, doc_id bigint, hash string, actor string, seq bigint, start_op bigint, max_op bigint, time_ms bigint, received_at timestamp, deps array<string>"
OPS = (
    "delivery_id bigint, doc_id bigint, op struct<ctr:bigint,actor:string>, obj struct<ctr:bigint,actor:string>, op_key string, elem struct<ctr:bigint,actor:string>, "
    "is_insert boolean, op_action tinyint, val struct<tag:string,i:bigint,u:decimal(20,0),d:double,s:string,b:binary,flag:boolean>, mark_name string, expand boolean, "
    "pred array<struct<ctr:bigint,actor:string>>, change_hash string"
)
ARCHIVE = "doc_id bigint, hash string"


def changes(spark, rows):
    """rows: (delivery_id, doc_id, hash, actor, seq, deps)."""
    return spark.createDataFrame([(i, d, h, a, s, s, s, None, None, deps) for i, d, h, a, s, deps in rows], CHANGES)


def op(i, doc, ctr, actor, action=1, key="k", obj=(0, ""), pred=(), tag="str", n=None, elem=None, insert=False):
    val = None if tag is None else (tag, n, None, None, "v" if tag == "str" else None, None, None)
    return (i, doc, (ctr, actor), obj, key, elem, insert, action, val, None, False, list(pred), "h")


def ops(spark, rows):
    return spark.createDataFrame(rows, OPS)


# ---- heavy keys


def test_profile_of_nulls_ties_and_repeats(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", None, 0), ("b", None, 0), (None, 5, 0), (None, 5, 0)], "k string, v int, weight int")
    rows = {r.k: tuple(r)[1:] for r in skew.key_profile(df, ["k"], "v").collect()}
    assert rows == {"a": (3, 2, 1, 1), "b": (1, 0, None, None), None: (2, 1, 5, 2)}
    assert skew.key_profile(df.limit(0), ["k"], "v").count() == 0
    assert {r.k for r in skew.heavy_keys(df, ["k"], "v", 3).collect()} == {"a"}


def test_percentiles_match_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice("aaaaaab"), None if r.random() < 0.1 else int(r.gauss(0, 300))) for _ in range(6000)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {x.k: tuple(x)[1:] for x in skew.key_percentiles(df, ["k"], "v", [0, 0.5, 0.9, 1], slices=16).collect()}
    want = {}
    for k in "ab":
        v = sorted(x for a, x in rows if a == k and x is not None)
        want[k] = tuple(v[max(0, int(np.ceil(p * len(v))) - 1)] for p in (0, 0.5, 0.9, 1))
    assert got == want


# ---- deliveries


def test_copies_with_and_without_hashes(spark):
    rows = [
        (1, 1, None, "A ", 1, []), (2, 1, " H1 ", "a", 1, []), (3, 1, "h1", "a", 1, []),  # one change, first seen without its hash
        (4, 1, "h2", "a", 1, []),  # the same seq with another hash is another change
        (5, 1, None, "b", 7, []), (6, 1, "", "b", 7, []),  # never had a hash
        (7, None, None, "b", 7, []), (8, None, None, "b", 7, []),  # nothing to tell it by
    ]
    c = changes(spark, rows).selectExpr("*", "1 AS kept", "'x' AS owner")
    assert sorted(r.delivery_id for r in delivery.further_copies(c).collect()) == [2, 3, 6]
    kept = {r.delivery_id: r.hash for r in delivery.keep_first(c).collect()}
    assert kept == {1: "h1", 4: "h2", 5: None, 7: None, 8: None}
    assert delivery.further_copies(c.limit(0)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b", "C", " c"]), st.integers(1, 2), st.sampled_from(["x", "y", None]), st.integers(1, 2)), max_size=14))
def test_copies_match_brute_force(spark, rows):
    rows = [(i, d, h, a, s, []) for i, (h, d, a, s) in enumerate(rows)]
    clean = lambda h: h.strip().lower() or None if h else None
    owner: dict = {}
    for i, d, h, a, s, _ in rows:
        if clean(h):
            owner.setdefault((d, a, s), clean(h))
    first, want = set(), []
    for i, d, h, a, s, _ in rows:
        who = clean(h) or (owner.get((d, a, s), (d, a, s)) if a is not None else i)
        want += [i] if who in first else []
        first.add(who)
    assert sorted(r.delivery_id for r in delivery.further_copies(changes(spark, rows)).collect()) == want


def test_latest_by_is_exact_on_ties(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 5, "b"), (1, 5, "b"), (None, 1, "z"), (None, None, "y")], "k int, t int, _row string")
    rows = sorted(map(tuple, delivery.latest_by(df, ["k"], "t").collect()), key=str)
    assert rows == [(1, 5, None), (None, None, "y")]


# ---- current entries


def _brute(rows):
    ops_ = {(r[1], r[2]): r for r in rows}
    gone = defaultdict(set)
    for (d, i), r in ops_.items():
        for p in r[11]:
            if p != i:
                gone[(d, p)].add(r[7])
    best = {}
    for (d, i), r in ops_.items():
        counter = r[8] is not None and r[8][0] == "counter"
        dead = any(a != 5 or not counter for a in gone[(d, i)])
        if r[4] is not None and r[7] not in (3, 5) and not dead:
            best[(d, r[3], r[4])] = max(best.get((d, r[3], r[4]), (0, "")), i)
    return {(d, "_root" if o[0] == 0 else f"{o[0]}@{o[1]}", k, f"{i[0]}@{i[1]}") for (d, o, k), i in best.items()}


@pytest.mark.parametrize("seed", range(3))
def test_entries_match_brute_force_in_any_order(spark, seed):
    r = random.Random(seed)
    rows, ids = [], []
    for c in range(1, 60):
        i = (c, r.choice("ab"))
        pred = r.sample(ids, min(len(ids), r.choice([0, 1, 1, 2]))) + ([(99, "z")] if r.random() < 0.1 else [])
        action = r.choice([1, 1, 1, 3, 5, 0])
        tag = r.choice(["str", "counter"]) if action == 1 else "int" if action == 5 else None
        rows.append(op(c, 1, *i, action=action, key=r.choice(["k", "l", "m", None]), obj=r.choice([(0, ""), (5, "a")]), pred=pred, tag=tag, n=1))
        ids.append(i)
    noisy = rows + r.choices(rows, k=30)
    r.shuffle(noisy)
    assert {tuple(x) for x in feed.current_entries(ops(spark, noisy)).collect()} == _brute(rows)
    half = [feed.op_facts(ops(spark, part)) for part in (noisy[:40], noisy[40:])]
    folded = feed.fold_ops(feed.fold_ops(half[1]).unionByName(feed.fold_ops(half[0])))
    assert {tuple(x) for x in folded.collect()} == {tuple(x) for x in feed.fold_ops(half[0].unionByName(half[1])).collect()}


def test_entries_of_nothing_nulls_and_late_deletes(spark):
    late = [op(1, 1, 2, "a", action=3, pred=[(1, "a")], tag=None), op(2, 1, 1, "A", key="k"), op(3, 1, 3, "a", key="self", pred=[(3, "a")])]
    assert [tuple(x) for x in feed.current_entries(ops(spark, late)).collect()] == [(1, "_root", "self", "3@a")]
    row = list(op(1, 1, 1, "a"))
    row[11] = row[8] = None
    assert feed.current_entries(ops(spark, [tuple(row)])).count() == 1
    assert feed.current_entries(ops(spark, [])).count() == 0


# ---- orphans


def test_orphans_direct_and_inherited(spark):
    c = changes(spark, [
        (1, 1, "a", "x", 1, []), (2, 1, "b", "x", 2, ["a", "gone"]), (3, 1, "c", "x", 3, [" B "]), (4, 1, "d", "x", 4, ["c", "old"]), (5, 1, "E", "y", 1, ["late"]),
        (6, 1, "late", "y", 2, None), (7, 2, "f", "y", 1, ["a", None, ""]), (8, 1, None, "x", 2, ["gone"]),
    ])
    o = ops(spark, [op(1, 1, 1, "x"), op(2, 1, 2, "x", pred=[(1, "x"), (9, "q")]), op(3, 1, 3, "x", pred=[(2, "x")]), op(3, 1, 3, "x", pred=[(2, "x")])])
    archive = spark.createDataFrame([(1, "old")], ARCHIVE)
    got = {tuple(r) for r in orphans.orphan_references(c, o, archive).collect()}
    assert got == {("changes", 1, "b", "gone"), ("changes", 2, "f", "a"), ("ops", 1, "2@x", "9@q")}
    cascade = {(r.ref_table, r.record_id, r.level == 0) for r in orphans.orphan_cascade(c, o, archive).collect()}
    assert cascade == {("changes", "b", True), ("changes", "c", False), ("changes", "d", False), ("changes", "f", True), ("ops", "2@x", True), ("ops", "3@x", False)}
    report = orphans.orphan_report(c, o, archive).collect()
    assert {(r.ref_table, r.n_references, r.n_direct, r.n_inherited) for r in report} == {("changes", 2, 2, 2), ("ops", 1, 1, 1)}
    nameless = changes(spark, [(1, 1, None, "x", 1, ["gone", "lost"])])
    assert {tuple(r)[2:] for r in orphans.orphan_report(nameless, o.limit(0)).collect()} == {(2, 0, 0)}
    assert orphans.orphan_references(c.limit(0), o.limit(0), archive.limit(0)).count() == 0


# ---- sessions


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 400))), max_size=40), st.sampled_from([1, 7, 50, 1000]))
def test_sessions_match_brute_force(spark, rows, chunk):
    df = spark.createDataFrame(rows, "actor string, time_ms bigint").selectExpr("*", "1 AS _k", "2 AS _n").drop("_k", "_n")
    got = sorted(tuple(r) for r in sessions.sessions(df, "actor", "time_ms", gap_ms=10, chunk_ms=chunk).collect())
    want = []
    for a in ("a", "b"):
        for t in sorted(t for k, t in rows if k == a and t is not None and t > 0):
            if want and want[-1][0] == a and t - want[-1][2] <= 10:
                want[-1][2], want[-1][4] = t, want[-1][4] + 1
                want[-1][3] = t - want[-1][1]
            else:
                want.append([a, t, t, 0, 1])
    assert got == [tuple(w) for w in want]


def test_clean_id(spark):
    rows = spark.createDataFrame([(" Ab\t",), ("",), ("  ",), (None,)], "h string").select(clean_id("h")).collect()
    assert [r[0] for r in rows] == ["ab", None, None, None]
    assert Counter() == Counter()
