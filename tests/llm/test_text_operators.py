"""Packing, leaked passages and toxic content: edge cases, brute force and held-out accuracy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opweave.llm import leaks, packing, toxicity
from opweave.llm.words import words

# ---- packing


@given(st.lists(st.integers(0, 70), max_size=80), st.integers(1, 6))
def test_containers_hold_every_item_once(sizes, open_bins):
    item, piece, container, start, n = packing.pack_sizes(np.array(sizes, dtype=np.int64), 20, open_bins)
    total = {}
    spans = {}
    for i, p, c, at, k in zip(item, piece, container, start, n):
        total[i] = total.get(i, 0) + k
        spans.setdefault(c, []).append((at, at + k))
        assert 0 <= at and at + k <= 20 and (k == 20 or sizes[i] - p * 20 == k)
    assert total == dict(enumerate(sizes))
    assert all(sizes[i] > 20 or item.count(i) == 1 for i in total)
    for s in spans.values():
        s = sorted(x for x in s if x[0] < x[1])
        assert all(a[1] == b[0] for a, b in zip(s, s[1:]))


def test_best_fit_takes_the_fullest_that_fits():
    fit = packing.BestFit(10, 8)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    fit = packing.BestFit(10, 1)
    assert [fit.place(n) for n in (6, 9, 4, 1)] == [(0, 0), (1, 0), (2, 0), (2, 4)]


def test_packing_texts(spark):
    rows = [(i, "word " * n if n is not None else None, "x") for i, n in enumerate([0, None, 1, 5000, 300, 300, 2100, *[40] * 200])] + [(None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n string")
    sizes = packing.count_tokens(df, "doc_id", "text").withColumnRenamed("id", "doc_id")
    out = packing.pack(sizes, "doc_id", "n_tokens").collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    used = {}
    for r in out:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) <= packing.CAPACITY and len(used) <= -(-sum(used.values()) // packing.CAPACITY) + 1
    assert packing.pack(sizes.limit(0), "doc_id", "n_tokens").count() == 0


# ---- leaks


def test_words_ignore_what_doesnt_matter():
    assert words("Él­ève  NAÏF,\n stra​ße!") == words("eleve naif strasse")
    assert words(None) == words("") == words(" .,") == []
    assert words("Ёлка йод") == ["елка", "иод"]


@given(st.lists(st.integers(0, 2), max_size=60))
def test_suffix_array(codes):
    codes = np.array(codes, dtype=np.int64)
    order = leaks.suffix_array(codes, 100).tolist()
    assert order == sorted(range(len(codes)), key=lambda i: codes[i:].tolist())


@settings(max_examples=60)
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=25), max_size=6), st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=5), st.integers(1, 4))
def test_matches_are_all_and_longest(docs, items, least):
    p = leaks.Passages([(k, " ".join(w), None) for k, w in enumerate(items)], least)
    got = [(r.doc_id, r.item_id, r.n_words, r.item_word, r.doc_word) for r in leaks._shard_matches(p, list(range(len(docs))), docs).itertuples()]
    want = set()
    for d, doc in enumerate(docs):
        for k, item in enumerate(items):
            for a in range(len(doc)):
                for b in range(len(item)):
                    n = 0
                    while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n]:
                        n += 1
                    if n >= least and not (a and b and doc[a - 1] == item[b - 1]):
                        want.add((d, k, n, b, a))
    assert set(got) == want and len(got) == len(want)


def test_leaks_in_tables(spark):
    passage = "one two three four five six seven eight nine"
    docs = [
        (1, f"before {passage.upper()}, after", "x"), (2, "one two three four five six seven", "x"), (3, passage.replace("five", "five very"), "x"), (4, None, "x"), (5, "", "x"),
        (6, "pad " * 3000 + passage.replace(" ", " - "), "x"), (6, passage, "x"), (None, passage, None),
    ]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, passage, None), (8, "short one", passage), (9, None, None)], "item_id bigint, src_text string, ref_text string")
    got = {tuple(r) for r in leaks.leaks(documents, items).collect()}
    assert got == {(d, i) for d in (1, 6, None) for i in (7, 8)}
    assert {r.doc_id for r in leaks.without_leaks(documents, items).collect() if r.doc_id is not None} == {2, 3, 4, 5}
    assert leaks.leaks(documents, items.limit(0)).count() == leaks.leaks(documents.limit(0), items).count() == 0
    assert {tuple(r) for r in leaks.leaked_passages(documents, items, shard_words=5).select("doc_id", "item_id").distinct().collect()} == got


# ---- toxic content


def test_disguises_are_undone():
    assert toxicity.plain("M0R0N, m o r o n; mo​ron morоn MORRRON m***n 12 m15t **bold**") == "moron moron moron moron moron mskd 0 mist bold".split()
    assert toxicity.plain(None) == toxicity.plain("") == toxicity.plain(" * .") == []
    assert toxicity.sides("ab\ncd", 2) == (["ab"], ["cd"]) and toxicity.sides("ab", None) == (["ab"], []) and toxicity.sides("ab", -1) == ([], ["ab"])


def _corpus(n=1500, seed=1):
    r = random.Random(seed)
    things, places = "lamp boat stone letter wagon candle".split(), "river hill market bridge tower".split()
    name = lambda: "".join(r.choice(["ka", "lo", "mi", "ra", "tu"]) for _ in range(3)).title()
    rows, truth = [], {}
    for i in range(n):
        text = " ".join(f"{name()} put the {r.choice(things)} near the {r.choice(places)}." for _ in range(r.randint(1, 4)))
        toxic = r.random() < 0.1
        if toxic:
            bad = r.choice(["{} you are a filthy scoundrel and nobody wants you here", "go away {} you rotten dog or i will hurt you"])
            text = f"{text} {bad.format(name())}"
        elif r.random() < 0.1:
            text += f" The word scoundrel is old, says the dictionary of {name()}."
        rows.append((i, text, None, "s" if i % 3 else None))
        truth[i] = toxic
    return rows, truth


def test_held_out_accuracy_and_rates(spark):
    rows, truth = _corpus()
    documents = spark.createDataFrame([*rows, (None, "a quiet text", 3, None), (9001, None, None, "s"), (9002, "", 0, "s"), (9003, "scoundrel " * 4000, 5, "s")], "doc_id bigint, text string, src_chars bigint, source string")
    rated = [(i, "abusive" if truth[i] else "none") for i in range(0, 1500, 2)]
    rated += [(0, None), (4, "none"), (4, "none" if truth[4] else "abusive"), (2, "none")]
    labels = spark.createDataFrame(rated, "doc_id bigint, category string")
    scores = toxicity.score(documents, toxicity.train(documents, labels))
    flags = {r.doc_id: r.toxic for r in scores.collect()}
    assert len(flags) == 1504 and not flags[9001] and not flags[9002]
    held = [i for i in range(1, 1500, 2)]
    hit = sum(flags[i] and truth[i] for i in held)
    assert hit / sum(truth[i] for i in held) > 0.9 and hit / max(1, sum(flags[i] for i in held)) > 0.9
    rates = {r.source: (r.n_docs, r.n_toxic) for r in toxicity.rates(documents, scores).collect()}
    assert rates["s"][0] + rates[None][0] == 1503 and rates["s"][1] + rates[None][1] == sum(flags.values())


def test_nothing_to_learn_from(spark):
    documents = spark.createDataFrame([(1, "a", 1)], "doc_id bigint, text string, src_chars bigint")
    labels = spark.createDataFrame([(1, "none")], "doc_id bigint, category string")
    model = toxicity.train(documents, labels)
    assert [tuple(r) for r in toxicity.score(documents, model).collect()] == [(1, 0, False)]
    assert toxicity.score(documents.limit(0), model).count() == 0


@pytest.mark.parametrize("votes,want", [(["none", "abusive"], None), (["none", "hateful", "sexual"], True), (["none"], False), ([None], None)])
def test_majority(spark, votes, want):
    got = toxicity.majority(spark.createDataFrame([(1, v) for v in votes], "doc_id bigint, category string")).collect()
    assert [r.toxic for r in got] == ([] if want is None else [want])
