"""Places of leaked passages, all of them, and items in several blocks."""

from __future__ import annotations

from opweave.llm import leaks

_A = "a b c d e f g h i j"


def test_every_place_is_found(spark, monkeypatch):
    documents = spark.createDataFrame([(1, f"x {_A} y {_A}"), (2, "c d e f g h i j k"), (3, "a b c"), (4, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, _A, "z"), (8, "q", f"{_A} k"), (9, None, "")], "item_id bigint, src_text string, ref_text string")
    want = {(1, 7, "src", 10, 0, 1), (1, 7, "src", 10, 0, 12), (1, 8, "ref", 10, 0, 1), (1, 8, "ref", 10, 0, 12), (2, 7, "src", 8, 2, 0), (2, 8, "ref", 9, 2, 0)}
    assert {tuple(r) for r in leaks.leaked_passages(documents, items).collect()} == want
    monkeypatch.setattr(leaks, "ITEMS_PER_BLOCK", 1)
    monkeypatch.setattr(leaks, "HITS_AT_ONCE", 1)
    assert {tuple(r) for r in leaks.leaked_passages(documents, items).collect()} == want
    longest = {tuple(r) for r in leaks.longest_matches(documents, items).collect()}
    assert longest == {w for w in want if w[5] != 12}
