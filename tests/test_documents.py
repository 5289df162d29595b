"""One document at a time: transactions, the binary format, synchronisation, text differences."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opweave.functions import columns as col
from opweave.functions.bloom import BloomFilter
from opweave.functions.leb128 import read_sleb, read_uleb, sleb, uleb
from opweave.functions.textdiff import edits
from opweave.operators import sync
from opweave.plans.transaction import ROOT_ID, DocumentError, Scalar, Snapshot, Transaction, import_json, strings_to_texts
from opweave.sources import chunks

A, B, C = "aa" * 4, "bb" * 4, "cc" * 4


def history(*writers):
    """Each writer (actor, seen, function) edits the changes it has seen; returns the changes."""
    out = []
    for actor, seen, edit in writers:
        s = Snapshot.of_changes([out[i] for i in seen])
        t = Transaction(s, actor)
        edit(t)
        out.append(t.commit(time_ms=len(out) + 1))
    return out


@given(st.integers(0, 2**64 - 1), st.integers(-(2**63), 2**63 - 1))
def test_leb128(u, s):
    assert read_uleb(uleb(u), 0) == (u, len(uleb(u)))
    assert read_sleb(sleb(s), 0) == (s, len(sleb(s)))


def test_leb128_rejects():
    for bad in (b"", b"\x80", b"\x81\x00", b"\xff" * 10 + b"\x01"):
        with pytest.raises(ValueError):
            read_uleb(bad, 0)


@given(st.lists(st.one_of(st.none(), st.integers(0, 5))), st.lists(st.booleans()))
def test_columns(values, flags):
    for kind in (col.INTEGER, col.DELTA):
        back = col.read_column(kind, col.write_column(kind, values))
        assert back + [None] * (len(values) - len(back)) == values
    back = col.read_column(col.BOOLEAN, col.write_column(col.BOOLEAN, flags))
    assert back + [False] * (len(flags) - len(back)) == flags


@given(st.lists(st.sampled_from("abc")), st.lists(st.sampled_from("abc")))
def test_edits(a, b):
    x = list(a)
    for at, n, add in edits(a, b):
        x[at : at + n] = add
    assert x == b


def test_edits_are_shortest():
    assert sum(n + len(add) for _, n, add in edits("abcabba", "cbabac")) == 5


def test_counter_increments_add_up():
    cs = history(
        (A, [], lambda t: t.put(ROOT_ID, "n", Scalar("counter", 0))),
        (A, [0], lambda t: t.increment(ROOT_ID, "n", 1)),
        (B, [0], lambda t: t.increment(ROOT_ID, "n", 2)),
    )
    assert Snapshot.of_changes(cs).get(ROOT_ID, "n") == 3


def test_conflicts_and_winner():
    cs = history((A, [], lambda t: t.put(ROOT_ID, "k", "one")), (B, [], lambda t: t.put(ROOT_ID, "k", "two")))
    s = Snapshot.of_changes(cs)
    assert s.get_all(ROOT_ID, "k") == ["one", "two"] and s.get(ROOT_ID, "k") == "two"
    t = Transaction(s, A)
    t.put(ROOT_ID, "k", "two")
    assert [o.action for o in t.ops] == [3] and s.get_all(ROOT_ID, "k") == ["two"]
    t.put(ROOT_ID, "k", "two")
    assert t.pending_ops() == 1


def test_inserts_at_the_same_place_dont_mix():
    def setup(t):
        t.put_object(ROOT_ID, "l", "list")

    def write(words):
        return lambda t: t.splice(t.doc.object(ROOT_ID, "l"), 0, 0, words)

    cs = history((A, [], setup), (A, [0], write("one two three".split())), (B, [0], write("four five six".split())))
    for order in (cs, [cs[0], cs[2], cs[1]]):
        s = Snapshot.of_changes(order)
        assert s.hydrate()["l"] == ["four", "five", "six", "one", "two", "three"]


def test_errors():
    s = Snapshot()
    t = Transaction(s, A)
    l, x = t.put_object(ROOT_ID, "l", "list"), t.put_object(ROOT_ID, "x", "text")
    for wrong, error in (
        (lambda: t.put(ROOT_ID, 0, 1), "InvalidOp"), (lambda: t.put(l, "k", 1), "InvalidOp"), (lambda: t.insert(l, 1, 1), "InvalidIndex"),
        (lambda: t.increment(ROOT_ID, "l", 1), "MissingCounter"), (lambda: t.put((9, A), "k", 1), "InvalidObjId"), (lambda: t.put(x, 0, "a"), "InvalidOp"),
        (lambda: t.splice(l, 0, -1), "InvalidIndex"), (lambda: t.update_object(l, {}), "ChangeType"), (lambda: t.mark(ROOT_ID, 0, 1, "b", True), "InvalidOp"),
    ):
        with pytest.raises(DocumentError, match=error):
            wrong()
    assert Transaction(Snapshot(), A).commit() is None


def test_text_marks_expand():
    s = Snapshot()
    t = Transaction(s, A)
    x = t.put_object(ROOT_ID, "x", "text")
    t.splice_text(x, 0, 0, "hello world")
    t.mark(x, 0, 5, "bold", True, "after")
    t.mark(x, 6, 11, "link", "u", "none")
    t.splice_text(x, 5, 0, "!")
    order = s.order[x]
    ends = [i for i in order if i in s.marks and s.marks[i].mark is None]
    written = [e for e in order if s.registers.get((x, e)) and s.registers[(x, e)][-1].value == "!"][0]
    assert order.index(written) < order.index(ends[0])
    assert s.text(x) == "hello! world"


@settings(max_examples=40, deadline=None)
@given(st.text("abc d", max_size=12), st.text("abc d", max_size=12))
def test_update_text(a, b):
    s = Snapshot()
    t = Transaction(s, A)
    x = t.put_object(ROOT_ID, "x", "text")
    t.update_text(x, a)
    t.update_text(x, b)
    assert s.text(x) == b


_JSON = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.floats(-9, 9), st.text("xyz", max_size=3)),
    lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.text("abc", min_size=1, max_size=2), v, max_size=3)), max_leaves=8,
)
_OBJECT = st.dictionaries(st.text("abc", min_size=1, max_size=2), _JSON, max_size=4)


@settings(max_examples=60, deadline=None)
@given(_OBJECT, _OBJECT)
def test_import_update_and_save(a, b):
    first = import_json(a, A)
    s = Snapshot.of_changes([first])
    assert s.hydrate() == a
    t = Transaction(s, B)
    t.update_object(ROOT_ID, b)
    second = t.commit(time_ms=7, message="more", empty=True)
    assert s.hydrate() == b
    for data in (chunks.encode_document([first, second]), chunks.encode_bundle([first, second])):
        back = chunks.decode(data)
        assert [c.hash for c in back] == [first.hash, second.hash]
        assert Snapshot.of_changes(back).hydrate() == b
        assert [c.message for c in back] == [None, "more"]


def random_history(seed: int, n: int = 30):
    r = random.Random(seed)
    cs, seen = [], {a: [] for a in (A, B, C)}
    start = Transaction(Snapshot(), A)
    start.put_object(ROOT_ID, "t", "text"), start.put_object(ROOT_ID, "l", "list"), start.put(ROOT_ID, "n", Scalar("counter", 1))
    cs.append(start.commit())
    for a in seen:
        seen[a].append(0)
    for _ in range(n):
        a = r.choice([A, B, C])
        if r.random() < 0.4:
            seen[a] = sorted({*seen[a], *seen[r.choice([A, B, C])]})
        s = Snapshot.of_changes([cs[i] for i in seen[a]])
        t = Transaction(s, a)
        text, lst = s.object(ROOT_ID, "t"), s.object(ROOT_ID, "l")
        for _ in range(r.randint(1, 3)):
            k = r.random()
            if k < 0.4:
                at = r.randint(0, s.length(text))
                t.splice_text(text, at, r.randint(0, 2), r.choice(["", "ab", "é😀"]))
            elif k < 0.6:
                t.splice(lst, r.randint(0, s.length(lst)), r.randint(0, 1), [r.randint(0, 9)])
            elif k < 0.7 and s.length(text) > 2:
                t.mark(text, 0, 2, "bold", True, r.choice(["before", "after", "both", "none"]))
            elif k < 0.8:
                t.increment(ROOT_ID, "n", r.randint(1, 5))
            elif k < 0.9:
                t.put(ROOT_ID, r.choice("xyz"), r.choice([1, 2.5, "s", b"\x00\xff", True, None, 2**63 + 5, Scalar("timestamp", 99)]))
            elif s.keys(ROOT_ID)[-1] in "xyz":
                t.delete(ROOT_ID, s.keys(ROOT_ID)[-1])
        c = t.commit(time_ms=r.randint(-5, 5))
        if c is not None:
            cs.append(c)
            seen[a].append(len(cs) - 1)
    return cs


@pytest.mark.parametrize("seed", range(6))
def test_random_histories_save_and_load(seed):
    cs = random_history(seed)
    data = chunks.encode_document(cs)
    back = chunks.decode(data)
    assert {c.hash for c in back} == {c.hash for c in cs}
    assert chunks.encode_document(back) == data
    want = Snapshot.of_changes(cs).hydrate()
    shuffled = back[:]
    random.Random(seed).shuffle(shuffled)
    assert Snapshot.of_changes(chunks._sorted_changes(shuffled)).hydrate() == want
    assert chunks.decode(b"".join(chunks.encode_change(c, deflate=True)[0] for c in cs))[0].hash == cs[0].hash


def test_broken_files():
    cs = random_history(3, 8)
    data = b"".join(chunks.encode_change(c)[0] for c in cs)
    assert chunks.decode(b"") == []
    for bad, error in ((data[:-1], "cut short"), (b"x" + data, "Magic"), (data[:20] + bytes([data[20] ^ 1]) + data[21:], "BadChecksum")):
        with pytest.raises(chunks.ChunkError, match=error):
            chunks.decode(bad)
    assert len(chunks.decode(data[:-1], partial="ignore")) == len(cs) - 1


def test_strings_to_texts():
    s = Snapshot.of_changes([import_json({"a": "hi", "l": ["x", 1]}, A)])
    assert strings_to_texts(s, B) is not None
    assert s.hydrate() == {"a": "hi", "l": ["x", 1]} and s.type_of(s.object(ROOT_ID, "a")) == "text"


@given(st.lists(st.binary(min_size=32, max_size=32), max_size=40), st.lists(st.binary(min_size=32, max_size=32), max_size=40))
def test_bloom(inside, others):
    f = BloomFilter.from_bytes(BloomFilter.of(inside).to_bytes())
    assert f.contains(inside).all()
    assert not inside or len(f.bits) == (10 * len(inside) + 7) // 8
    assert BloomFilter().contains(others).sum() == 0


def test_bloom_rate():
    r = random.Random(1)
    f = BloomFilter.of(r.randbytes(32) for _ in range(2000))
    assert f.contains([r.randbytes(32) for _ in range(20000)]).mean() < 0.02


@pytest.mark.parametrize("seed", range(4))
def test_sync_converges(seed):
    cs = random_history(seed, 40)
    r = random.Random(seed)
    have = lambda: {i for i in range(len(cs)) if r.random() < 0.6}

    def closed(some):
        d = sync.Replica(cs)
        keep = d.ancestors(cs[i].hash for i in some)
        return sync.Replica(c for c in cs if c.hash in keep)

    x, y = closed(have()), closed(have())
    a, b = sync.State(), sync.State()
    for _ in range(20):
        m, n = sync.generate(x, a), sync.generate(y, b)
        if m is None and n is None:
            break
        if m is not None:
            sync.receive(y, b, sync.Message.decode(m.encode()))
        if n is not None:
            sync.receive(x, a, sync.Message.decode(n.encode()))
    assert x.heads() == y.heads() and set(x.known) == set(y.known)
    assert sync.State.decode(a.encode()).shared_heads == x.heads()


def test_duplicate_seq_is_refused():
    cs = history((A, [], lambda t: t.put(ROOT_ID, "k", 1)), (A, [], lambda t: t.put(ROOT_ID, "k", 2)))
    with pytest.raises(ValueError, match="DuplicateSeqNumber"):
        sync.Replica(cs)


def test_cursors():
    s = Snapshot()
    t = Transaction(s, A)
    x = t.put_object(ROOT_ID, "x", "text")
    t.splice_text(x, 0, 0, "abcdef")
    after, before = s.cursor(x, 3), s.cursor(x, 3, "before")
    assert s.cursor_position(x, after) == s.cursor_position(x, before) == 3
    t.splice_text(x, 2, 3)
    assert s.text(x) == "abf" and s.cursor_position(x, after) == 2 and s.cursor_position(x, before) == 1
    t.splice_text(x, 0, 2)
    assert s.cursor_position(x, before) == 0 and s.cursor_position(x, s.cursor(x, "end")) == 1 == s.length(x)
    with pytest.raises(DocumentError, match="InvalidCursor"):
        s.cursor_position(x, "99@zz")


def _packed(c):
    ids = [o.id for o in c.ops]
    return chunks.Packed(
        c.hash, c.actor, c.seq, c.start_op, c.deps, chunks.encode_tail(c), None if ids == [(c.start_op + k, c.actor) for k in range(len(ids))] else ids,
        chunks._crc(o.id for o in c.ops if o.action != 3), chunks._crc(p for o in c.ops for p in o.pred),
    )


@pytest.mark.parametrize("seed", range(4))
def test_documents_of_packed_changes(seed):
    """a document was gathered as Python objects; its changes as bytes give the same document, or the same changes if it can't be one."""
    cs = random_history(seed)
    digest = lambda c: chunks.chunk(chunks.CHANGE, c.content)[1]
    assert chunks.save_packed(chunks.rehash([_packed(c) for c in cs], digest)) == chunks.encode_document(cs)
    random.Random(seed).choice([o for c in cs for o in c.ops]).pred.append((10_000, B))
    want = chunks.rehash(cs)
    data = chunks.save_packed(chunks.rehash([_packed(c) for c in cs], digest))
    assert data == chunks.save_and_verify(want) == chunks.encode_bundle(want)
    assert chunks.count(data) == (len(cs), sum(len(c.ops) for c in cs))


def test_a_document_that_cannot_be_one_is_never_objects():
    """all operations of a document were objects at once, however many, and three times over."""
    import tracemalloc

    actor, n = "%032x" % 7, 4000
    deps, cs = [], []
    for k in range(n):
        ops = [chunks.Op((8 * k + i + 1, actor), (0, ""), f"key{i}", None, False, 1, "str", "v" * 9, [(10**9 + k, actor)]) for i in range(8)]
        c = chunks.Change(actor, k + 1, 8 * k + 1, 0, None, deps, ops, b"", f"{k:064x}")
        deps = [c.hash]
        cs.append(_packed(c))
    tracemalloc.start()
    data = chunks.save_packed(chunks.rehash(cs, lambda c: chunks.chunk(chunks.CHANGE, c.content)[1]))
    assert chunks.count(data) == (n, 8 * n)
    assert tracemalloc.get_traced_memory()[1] < 200 * 8 * n  # objects take over 600 bytes an operation
    tracemalloc.stop()


def test_loops_are_left_out_in_one_pass():
    """each round of the search for changes on loops went over all changes, and there was a round for each step of a chain."""
    n = 20_000
    cs = [chunks.Packed(f"{k:064x}", "aa", k, k, [f"{k - 1:064x}"] if k else [], b"") for k in range(n)]
    cs[-2].deps.append(cs[-1].hash)
    ordered, looped = chunks._sorted(cs[::-1])
    assert [c.seq for c in ordered] == [*range(n - 2)] and {c.seq for c in looped} == {n - 2, n - 1}
