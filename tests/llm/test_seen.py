"""Seen keys: quotient filters and the answers from them."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opweave.llm import quotient, seen

_FPS = st.lists(st.integers(0, (1 << 20) - 1), max_size=200)


@settings(max_examples=60, deadline=None)
@given(_FPS, _FPS)
def test_quotient_filter(a, b):
    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    x, y = quotient.encode(a, 8, 12), quotient.encode(b, 8, 12)
    assert (quotient.decode(x) == np.unique(a)).all() and quotient.size(x) == len(np.unique(a))
    both = quotient.merge(x, y)
    assert both == quotient.encode(np.concatenate([a, b]), 8, 12)
    assert (quotient.probe(x, np.concatenate([a, b])) == np.isin(np.concatenate([a, b]), a)).all()
    with pytest.raises(ValueError):
        quotient.merge(x, quotient.encode(b, 9, 11))


def _records(r):
    earlier = [f"k{r.randrange(300)}" for _ in range(400)] + [None]
    records = [(i, r.choice([None, "hot", f"k{r.randrange(900)}"])) for i in range(1500)]
    r.shuffle(records)
    known, new = set(earlier), set()
    for i, k in sorted(records):
        if k is not None and k not in known:
            new.add(i)
            known.add(k)
    return earlier, records, new


@pytest.mark.parametrize("ranges", [1, 5])
def test_seen_before(spark, ranges):
    earlier, records, new = _records(random.Random(4))
    frames = spark.createDataFrame(records, "id bigint, key string"), spark.createDataFrame([(k,) for k in earlier], "key string")
    want = {i for i, k in records if k is not None and i not in new}
    assert {r.id for r in seen.SeenBefore(*frames, "id", "key", ranges=ranges).found().collect()} == want
    coarse = seen.SeenBefore(*frames, "id", "key", 2, ranges)
    got, wrong = ({r.id for r in df.collect()} for df in (coarse.found(), coarse.wrong()))
    assert want <= got and wrong <= got - want and wrong
    e = coarse.errors().first()
    assert (e.n_found, e.n_wrong, e.remainder_bits) == (len(got), len(wrong), 2) and 0.3 < e.measured_rate / e.derived_rate < 3


def test_seen_before_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, key string")
    some = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (None, "a")], "id bigint, key string")
    assert seen.SeenBefore(none, none, "id", "key").found().count() == 0
    assert [r.id for r in seen.SeenBefore(some, none, "id", "key").found().collect()] == [3]


def test_geometry():
    assert seen.Geometry.for_keys(10**9).r == seen.REMAINDER_BITS
    with pytest.raises(ValueError):
        seen.Geometry.for_keys(10**13)
