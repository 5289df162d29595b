"""What counts as toxic text doesn't depend on how much was rated."""

from __future__ import annotations

import random

import pytest

from opweave.llm import toxicity


def _rated(n_toxic):
    r = random.Random(n_toxic)
    name = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4))
    toxic = [f"{name()} {name()} you filthy scoundrel {name()}" for _ in range(n_toxic - 4)]
    toxic += [f"{name()} wretched gobemouche {name()}" for _ in range(4)]
    ordinary = [f"{name()} walks along the river with {name()}" for _ in range(n_toxic)]
    return toxicity.Ratings([(i, k < n_toxic, (text.split(), [])) for i, (k, text) in enumerate(enumerate(toxic + ordinary))])


def _counts(r):
    return dict(toxicity._documents_with(s for _, _, s in r.rated))


@pytest.mark.parametrize("n_toxic", [60, 500, 1600])
def test_a_rare_insult_is_known_at_every_size(n_toxic):
    r = _rated(n_toxic)
    df = {g: n for g, n in _counts(r).items() if g in r.wanted()}
    t = toxicity.telling(r, df, 50 * n_toxic)
    assert {("wretched", "gobemouche"), ("filthy", "scoundrel"), ("gobemouche",)} <= t.toxic
    model = toxicity.dictionaries(r, t)
    assert toxicity.coded(["wretched", "gobemouche"]) in model.toxic and toxicity.coded(["filthy", "scoundrel"]) in model.toxic
    assert model.gain([["he", "wretched", "gobemouche", "went"]]) > toxicity.USUAL_GAIN > model.gain([["he", "walks", "along", "the", "river"]])


def test_a_word_with_harmless_uses_needs_its_toxic_neighbours():
    r = _rated(200)
    df = {g: n for g, n in _counts(r).items() if g in r.wanted()}
    df[("scoundrel",)] += 2000  # documents that nobody rated
    t = toxicity.telling(r, df, 10_000)
    assert ("scoundrel",) in t.mixed and ("filthy", "scoundrel") in t.toxic
    model = toxicity.dictionaries(r, t)
    assert model.gain([["scoundrel"]]) < 3 < model.gain([["filthy", "scoundrel"]])


def test_lookup_equals_all_phrases():
    rnd = random.Random(5)
    words = [rnd.choice("abcd") for _ in range(300)]
    wanted = {g for _, g in toxicity.phrases([rnd.choice("abcdef") for _ in range(60)]) if rnd.random() < 0.5}
    assert toxicity.Lookup(wanted).find(words) == {g for _, g in toxicity.phrases(words)} & wanted


def test_no_window_gains_more_than_compression_says():
    r = _rated(60)
    model = toxicity.dictionaries(r, toxicity.telling(r, {g: n for g, n in _counts(r).items() if g in r.wanted()}, 3000))
    rnd = random.Random(3)
    for _ in range(200):
        side = [rnd.choice("you filthy scoundrel walks along river stranger another wretched".split()) for _ in range(6)]
        brute = 0
        for n in toxicity.WINDOWS:
            for k in range(len(side) - n + 1):
                b = b"".join(toxicity.coded([w]) if w in model.known_words else toxicity._STRANGE for w in side[k : k + n]) + toxicity._END
                ordinary, toxic = model._compressors()
                brute = max(brute, len(ordinary(b)) - len(toxic(b)))
        assert 0 <= model.gain([side]) <= brute
