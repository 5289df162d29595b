"""State read from logs by Spark against the same histories applied one by one."""

from __future__ import annotations

import json

import pytest

from opweave.operators import diff, graph, hydrate, merge, richtext, sequence, state
from opweave.plans.transaction import ROOT_ID, Snapshot, Transaction
from opweave.sources import chunks, interchange
from tests.test_documents import A, random_history


@pytest.fixture(scope="module")
def logs(spark):
    history = {seed: random_history(seed, 14) for seed in (11, 12)}
    rows = [chunks.change_row(d, c) for d, cs in history.items() for c in cs]
    nested = spark.createDataFrame(rows, chunks.ROWS)
    c, o = chunks.tables(nested)
    return history, nested.cache(), c.cache(), o.cache()


def test_documents_and_texts(logs):
    history, _, c, o = logs
    order = sequence.element_order(o)
    visible = state.visible_ops(o)
    texts = richtext.texts(richtext.text_items(o, visible, order))
    got = {r.doc_id: json.loads(r.json) for r in hydrate.documents_json(visible, order, texts).collect()}
    for d, cs in history.items():
        want = Snapshot.of_changes(cs).hydrate()
        want = {k: list(v) if isinstance(v, bytes) else v for k, v in want.items()}
        assert got[d] == want
    lengths = {(r.doc_id, r.obj_id): r.length for r in state.lengths(visible).collect()}
    for d, cs in history.items():
        assert lengths[(d, "_root")] == len(Snapshot.of_changes(cs).keys(ROOT_ID))


def test_reading_a_past_version(logs):
    history, _, c, o = logs
    d, cs = next(iter(history.items()))
    some = c.where(f"doc_id = {d}")
    at = some.sparkSession.createDataFrame([(d, cs[7].hash)], "doc_id bigint, hash string")
    seen = {r.hash for r in graph.ancestors(some, at).collect()}
    old = [x for x in cs if x.hash in seen]
    visible = state.visible_ops(o.where(f"doc_id = {d}"), graph.clock(some, at))
    got = {(r.reg, r.value) for r in state.get(visible).collect() if r.obj_id == "_root" and r.kind not in ("text", "list", "bytes", "f64", "bool", "null")}
    s = Snapshot.of_changes(old)
    want = {(k, str(s.get(ROOT_ID, k))) for k in s.keys(ROOT_ID) if isinstance(s.get(ROOT_ID, k), (int, str)) and not isinstance(s.get(ROOT_ID, k), bool) and k not in "tl"}
    assert got == want
    now = state.visible_ops(o.where(f"doc_id = {d}"))
    applied = diff.apply_patches(state.get(visible), diff.register_diff(visible, now))
    patches = diff.diff_versions(some, o, at)
    assert patches.count() == diff.register_diff(visible, now).count()
    assert diff.within(patches, state.paths(o, now), d, "l").select("obj_id").distinct().count() <= 1
    key = ["doc_id", "obj_id", "reg", "value", "conflict"]
    assert applied.select(*key).exceptAll(state.get(now).select(*key)).count() == 0
    assert state.get(now).select(*key).exceptAll(applied.select(*key)).count() == 0


def test_marks_follow_the_log(logs):
    history, _, c, o = logs
    order = sequence.element_order(o)
    items = richtext.text_items(o, state.visible_ops(o), order)
    got = {}
    for r in richtext.marks(items, richtext.mark_intervals(o, order)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    for d, cs in history.items():
        s = Snapshot.of_changes(cs)
        x = s.object(ROOT_ID, "t")
        want, at, open_ = set(), 0, set()
        for e in s.order[x]:
            m = s.marks.get(e)
            if m is not None:
                open_ = open_ | {e} if m.mark else open_ - {(e[0] - 1, e[1])}
            for op in s.registers.get((x, e), []):
                want |= set(range(at, at + len(op.value))) if open_ else set()
                at += len(op.value)
        assert got.get(d, set()) == want


def test_snapshot_of_tables_writes_on(logs):
    history, _, c, o = logs
    d, cs = next(iter(history.items()))
    s = Snapshot.read(c, o, d)
    want = Snapshot.of_changes(cs)
    assert s.hydrate() == want.hydrate() and s.heads == want.heads and s.max_op == want.max_op
    for snap in (s, want):
        t = Transaction(snap, A)
        t.put(ROOT_ID, "new", 1)
        t.splice_text(snap.object(ROOT_ID, "t"), 0, 1, "Q")
        snap.hash = t.commit(time_ms=5).hash
    assert s.hash == want.hash


def test_files_json_and_merges(spark, logs, tmp_path):
    history, nested, c, o = logs
    for d, cs in history.items():
        (tmp_path / f"{d}.bin").write_bytes(chunks.encode_document(cs))
    back = chunks.read_files(spark, str(tmp_path))
    assert {r.hash for r in back.select("hash").collect()} == {x.hash for cs in history.values() for x in cs}
    assert {(r.hash, r.stored_hash) for r in chunks.change_bytes(nested).collect()} == {(x.hash, x.hash) for cs in history.values() for x in cs}
    again = interchange.from_json(interchange.to_json(nested))
    assert {(r.hash, r.stored_hash) for r in chunks.change_bytes(again).collect()} == {(x.hash, x.hash) for cs in history.values() for x in cs}
    a, b = c.where("seq % 2 = 0"), c.where("seq % 3 < 2")
    ab, ba = merge.merge_changes(a, b), merge.merge_changes(b, a)
    assert ab.exceptAll(ba).count() == ba.exceptAll(ab).count() == 0 and merge.merge_changes(ab, ab).count() == ab.count()
    applied, waiting = merge.apply_changes(c.limit(0), c.where("start_op > 1"))
    assert applied.count() == 0 and waiting.count() == c.where("start_op > 1").count()


def test_value_functions(spark):
    from opweave.functions import values as v

    row = spark.createDataFrame([([1, 2, 3, 2],)], "a array<int>").selectExpr("a", "named_struct('tag','f64','i',cast(null as bigint),'u',cast(null as decimal(20,0)),'d',2.7D) AS f", "named_struct('tag','uint','i',cast(null as bigint),'u',cast('18446744073709551615' as decimal(20,0)),'d',cast(null as double)) AS u")
    from pyspark.sql import functions as F

    a, f, u = F.col("a"), F.col("f"), F.col("u")
    got = row.select(
        v.at(a, -1), v.at(a, 9), v.index_of(a, 2), v.index_of(a, 7), v.last_index_of(a, 2), v.includes(a, 3), v.slice_of(a, -2), v.splice_of(a, 1, 2, 9), v.find(a, lambda x: x > 1),
        v.find_index(a, lambda x: x > 2), v.join(a, "-"), v.to_int(f), v.to_uint(u), v.to_int(u), v.to_double(u), v.is_number(f), v.is_kind(f, "str"),
    ).first()
    assert tuple(got) == (2, None, 1, -1, 3, True, [3, 2], [1, 9, 2], 2, 2, "1-2-3-2", 2, 18446744073709551615, None, 2.0**64, True, False)
