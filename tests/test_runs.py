"""Logs in runs against the operations that they stand for."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from opweave.operators import richtext, runs, sequence, state
from opweave.plans import fixtures

_SCHEMA = (
    f"doc_id bigint, op {fixtures._ID}, obj {fixtures._ID}, op_key string, elem {fixtures._ID}, is_insert boolean, op_action tinyint, "
    f"val {fixtures._VAL}, mark_name string, run_n bigint, expand boolean, pred array<{fixtures._ID}>"
)
_DOCUMENTS = "doc_id bigint, text string, lang string, source string"


def _string(s):
    return ("str", None, None, None, s, None, None)


def edited(seed: int, doc_id: int) -> list[tuple]:
    """A text that two actors typed in runs, deleted from, wrote over, marked; some of it delivered again in other runs."""
    r = random.Random(seed)
    rows, live, ctr, text = [(doc_id, (1, "aa"), (0, ""), "text", None, False, 4, None, None, 1, False, [])], [], 1, (1, "aa")

    def add(op, elem, insert, action, val=None, mark=None, n=1, pred=()):
        rows.append((doc_id, op, text, None, elem, insert, action, val, mark, n, False, list(pred)))

    for _ in range(14):
        actor, ctr = r.choice(["aa", "bb"]), ctr + r.randrange(1, 4)
        at = r.choice(live) if live else (0, "")
        what = r.random() if live else 0
        if what < 0.5:
            s = "".join(r.choice("xyzé😀\n") for _ in range(r.choice([1, 2, 5, 9000])))
            add((ctr, actor), at if r.random() < 0.8 else (0, ""), True, 1, _string(s), n=len(s))
            if len(s) > 4:  # delivered again in two parts
                k = r.randrange(1, len(s))
                add((ctr + k, actor), (ctr + k - 1, actor), True, 1, _string(s[k:]), n=len(s) - k)
                add(*rows[-2][1:2], rows[-2][4], True, 1, _string(s[:k]), n=k)
            live += [(ctr + i, actor) for i in range(len(s))]
            ctr += len(s)
        elif what < 0.7:
            add((ctr, actor), at, False, 3, pred=[at])
        elif what < 0.8:
            add((ctr, actor), at, False, 1, _string("two"), pred=[at])
        else:
            add((ctr, actor), at, True, 7, _string(r.choice("uv")), mark=r.choice("mn"))
            add((ctr + 1, actor), r.choice(live), True, 7)
            ctr += 1
    return rows


def _of_runs(log):
    cut = runs.pieces(log)
    order = sequence.element_order(cut)
    return order, richtext.text_items(cut, state.visible_ops(cut), order), richtext.mark_intervals(log, order), lambda items: runs.fill(items, log)


def _of_operations(log):
    ops = runs.expand(log)
    order = sequence.element_order(ops)
    return order, richtext.text_items(ops, state.visible_ops(ops), order), richtext.mark_intervals(ops, order)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_runs_mean_their_operations(spark):
    log = spark.createDataFrame([row for k in range(6) for row in edited(k, k)], _SCHEMA)
    order, items, intervals, fill = _of_runs(log)
    want_order, want_items, want_intervals = _of_operations(log)
    each = order.select("doc_id", "obj", F.inline(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("run_n") - 1), lambda i: F.struct(
        F.struct((F.col("elem.ctr") + i).alias("ctr"), F.col("elem.actor").alias("actor")).alias("elem"), (F.col("pos") + i).alias("pos")))))
    assert _rows(each) == _rows(want_order)
    assert _rows(richtext.texts(fill(items))) == _rows(richtext.texts(want_items))
    assert _rows(richtext.marks(items, intervals)) == _rows(richtext.marks(want_items, want_intervals))
    assert _rows(richtext.spans(items, intervals, fill)) == _rows(richtext.spans(want_items, want_intervals))


@pytest.fixture(scope="module")
def documents(spark):
    texts = ["", None, "a", "ab", "abc", "a\nb😀é", "long 😀 " * 2000]
    return spark.createDataFrame([(k, t, None if k % 3 == 0 else "en", None if k % 4 == 1 else "s") for k, t in enumerate(texts)], _DOCUMENTS)


def test_typed_order_takes_no_row_for_each_character(documents):
    """a text typed in one go was a row, and two nodes, for each character."""
    log = fixtures.marked_texts(documents)
    order = sequence.element_order(runs.pieces(log))
    assert log.count() <= 7 * 7
    assert order.count() <= 7 * (5 + 3 + 2 * 16000 // runs.STRETCH)
    got = {x.doc_id: x.n for x in order.groupBy("doc_id").agg(F.sum("run_n").alias("n")).collect()}
    assert got == {x.doc_id: len(x.text or "") + 5 for x in documents.collect()}


def _spans(x):
    """What the marks of fixtures.marked_texts make of a text: runs of characters with the same marks."""
    t, out = x.text or "", []
    n = len(t)
    for i, c in enumerate(t):
        held = ",".join([f"lang={x.lang}"] * (x.lang is not None and i < n // 2) + [f"source={x.source}"] * (x.source is not None and i >= n // 4))
        out = [*out[:-1], (out[-1][0] + c, held)] if out and out[-1][1] == held else [*out, (c, held)]
    return [(None, ""), *out]


def test_typed_spans_take_no_item_for_each_character(documents):
    """items were single characters, each joined with every mark."""
    _, items, intervals, fill = _of_runs(fixtures.marked_texts(documents))
    assert items.count() <= 7 * (4 + 2 * 16000 // runs.STRETCH)
    got = sorted((x.doc_id, x.span_no, x.text, x.marks) for x in richtext.spans(items, intervals, fill).collect())
    assert got == [(x.doc_id, k, *s) for x in documents.collect() for k, s in enumerate(_spans(x), 1)]


def test_typed_texts_are_shuffled_as_runs(documents):
    """a text was put together from an item for each character."""
    _, items, _, fill = _of_runs(fixtures.marked_texts(documents))
    filled = fill(items)
    assert filled.count() <= 7 * (4 + 2 * 16000 // runs.STRETCH)
    got = {x.doc_id: (x.text[1:], x.length - 1) for x in richtext.texts(filled).collect()}
    assert got == {x.doc_id: (x.text or "", len(x.text or "")) for x in documents.collect()}


def test_typed_marks_meet_pieces(documents):
    """each character met each mark of its text."""
    _, items, intervals, _ = _of_runs(fixtures.marked_texts(documents))
    assert richtext.item_marks(items, intervals).count() <= 7 * 2 * (4 + 16000 // runs.STRETCH)
    got = {(x.doc_id, x.name): (x.value, x.start, x.end) for x in richtext.marks(items, intervals).collect()}
    want = {}
    for x in documents.collect():
        n = len(x.text or "")
        want |= {(x.doc_id, "lang"): (x.lang, 1, 1 + n // 2)} if x.lang is not None and n > 1 else {}
        want |= {(x.doc_id, "source"): (x.source, 1 + n // 4, 1 + n)} if x.source is not None and n else {}
    assert got == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_read_the_log_once(documents):
    """cuts were joined with the runs, so each of the six readers of the pieces planned the log three times."""
    log = fixtures.marked_texts(documents)
    plan = _plan(runs.pieces(log))
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert plan.count("Scan ExistingRDD") == 2


def test_text_objects_are_found_without_their_texts(documents):
    """the text objects were looked for in the pieces, after the whole log was shuffled with its values once more."""
    log = fixtures.marked_texts(documents)
    plan = _plan(richtext.text_objects(log))
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1
    assert {tuple(x) for x in richtext.text_objects(log).select("doc_id", "obj.ctr").collect()} == {(k, 1) for k in range(7)}
