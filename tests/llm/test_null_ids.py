"""Documents with null and repeated ids."""

from __future__ import annotations

from opweave.llm import leaks, toxicity


def test_leaking_document_without_id_goes(spark):
    passage = "one two three four five six seven eight nine"
    documents = spark.createDataFrame([(1, "clean"), (2, passage), (None, passage)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, passage, None)], "item_id bigint, src_text string, ref_text string")
    assert [r.doc_id for r in leaks.without_leaks(documents, items).collect()] == [1]


def test_rates_count_every_document_once(spark):
    rows = [(1, "a", 1, "s"), (1, "b", 1, "s"), (None, "c", 1, "s"), (2, "d", 1, None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, src_chars bigint, source string")
    scored = toxicity.score(documents, toxicity.fit(toxicity.Ratings([]), {}, 0), "source")
    assert {r.source: (r.n_docs, r.n_toxic) for r in toxicity.source_rates(scored).collect()} == {"s": (3, 0), None: (1, 0)}
