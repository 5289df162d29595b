"""Reconciling replicas: what a peer has is told by a Bloom filter, what it lacks is sent."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bloom import BloomFilter
from ..functions.leb128 import read_uleb, uleb
from ..sources.chunks import Change, decode, encode_change, encode_document
from .blocks import close
from .graph import KEY, ancestors

# First bytes of messages and states, and what a peer can say of itself.
MESSAGE_V1, MESSAGE_V2, STATE = 0x42, 0x43, 0x43
CAPABILITIES = (1, 2)


def make_filters(changes: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``n_hashes``, ``bloom``: a filter for each document of the changes since the shared heads."""
    since = changes.select(*KEY) if shared is None else changes.select(*KEY).join(ancestors(changes, shared), KEY, "left_anti")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BloomFilter.of(bytes.fromhex(h) for h in pdf["hash"])
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "n_hashes": [len(pdf)], "bloom": [f.to_bytes()]})

    return since.groupBy("doc_id").applyInPandas(build, "doc_id bigint, n_hashes bigint, bloom binary")


def hashes_to_send(changes: DataFrame, filters: DataFrame, shared: DataFrame | None = None, need: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``hash`` of the changes that peers with these ``filters`` (``doc_id``, ``bloom``) lack.

    Of the changes since the shared heads: those that no filter holds, all that depend on them, and
    those asked for.  Of a document without filters only what is asked for.
    """
    fresh = changes if shared is None else changes.join(ancestors(changes, shared), KEY, "left_anti")

    def test(c: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(f):
            return pd.DataFrame({"doc_id": [], "hash": [], "seed": []})
        raw = [bytes.fromhex(h) for h in c["hash"]]
        held = sum(BloomFilter.from_bytes(bytes(b)).contains(raw).astype(int) for b in f["bloom"]) > 0
        return pd.DataFrame({"doc_id": c["doc_id"], "hash": c["hash"], "seed": ~held})

    seeds = fresh.select(*KEY).groupBy("doc_id").cogroup(filters.select("doc_id", "bloom").groupBy("doc_id")).applyInPandas(test, "doc_id bigint, hash string, seed boolean")
    nodes = fresh.join(seeds, KEY).select(
        F.col("doc_id").cast("string").alias("g"), F.col("start_op").alias("ord"), F.col("hash").alias("id"), F.col("deps").alias("parents"), "seed"
    )
    out = close(nodes, fresh.select(F.col("doc_id").cast("string").alias("g"), F.col("start_op").alias("ord")), "any").where("flag")
    rows = out.select(F.col("g").cast("bigint").alias("doc_id"), F.col("id").alias("hash"))
    return rows if need is None else rows.unionByName(need.select(*KEY)).distinct()


# ---- the protocol between two peers about one document


@dataclass
class Have:
    last_sync: list[str] = field(default_factory=list)
    bloom: BloomFilter = field(default_factory=BloomFilter)


@dataclass
class Message:
    heads: list[str]
    need: list[str]
    have: list[Have]
    changes: list[bytes]
    capabilities: list[int] | None = None
    version: int = MESSAGE_V1

    def encode(self) -> bytes:
        hashes = lambda hs: uleb(len(hs)) + b"".join(bytes.fromhex(h) for h in sorted(hs))
        sized = lambda b: uleb(len(b)) + b
        out = bytes([self.version]) + hashes(self.heads) + hashes(self.need) + uleb(len(self.have))
        out += b"".join(hashes(h.last_sync) + sized(h.bloom.to_bytes()) for h in self.have)
        out += uleb(len(self.changes)) + b"".join(map(sized, self.changes))
        return out if self.capabilities is None else out + sized(bytes(self.capabilities))

    @classmethod
    def decode(cls, data: bytes) -> Message:
        if not data or data[0] not in (MESSAGE_V1, MESSAGE_V2):
            raise ValueError(f"WrongType: {data[:1].hex()}")
        at = 1

        def number() -> int:
            nonlocal at
            n, at = read_uleb(data, at)
            return n

        def take(n: int) -> bytes:
            nonlocal at
            if at + n > len(data):
                raise ValueError("NotEnoughInput")
            at += n
            return data[at - n : at]

        hashes = lambda: [take(32).hex() for _ in range(number())]
        heads, need = hashes(), hashes()
        have = [Have(hashes(), BloomFilter.from_bytes(take(number()))) for _ in range(number())]
        changes = [take(number()) for _ in range(number())]
        caps = list(take(number())) if at < len(data) else None
        return cls(heads, need, have, changes, caps, data[0])


@dataclass
class State:
    """What is known of a peer.  Only ``shared_heads`` outlive a connection."""

    shared_heads: list[str] = field(default_factory=list)
    last_sent_heads: list[str] | None = None
    their_heads: list[str] | None = None
    their_need: list[str] | None = None
    their_have: list[Have] | None = None
    their_capabilities: list[int] | None = None
    sent: set[str] = field(default_factory=set)
    in_flight: bool = False

    def encode(self) -> bytes:
        return bytes([STATE]) + uleb(len(self.shared_heads)) + b"".join(bytes.fromhex(h) for h in sorted(self.shared_heads))

    @classmethod
    def decode(cls, data: bytes) -> State:
        if data[:1] != bytes([STATE]):
            raise ValueError("WrongType")
        n, at = read_uleb(data, 1)
        return cls([data[at + 32 * k : at + 32 * (k + 1)].hex() for k in range(n)])


class Replica:
    """A document's history held by a peer: known changes by hash and those that wait for others."""

    def __init__(self, changes: Iterable[Change] = ()):
        self.known: dict[str, Change] = {}
        self.waiting: dict[str, Change] = {}
        self.places: dict[tuple[str, int], str] = {}
        self.apply(changes)

    def apply(self, changes: Iterable[Change]) -> None:
        for c in changes:
            if c.hash not in self.known:
                if self.places.setdefault((c.actor, c.seq), c.hash) != c.hash:
                    raise ValueError(f"DuplicateSeqNumber: {c.seq} of {c.actor}")
                self.waiting[c.hash] = c
        grew = True
        while grew:
            go = [c for c in self.waiting.values() if all(d in self.known for d in c.deps)]
            for c in go:
                self.known[c.hash] = self.waiting.pop(c.hash)
            grew = bool(go)

    def heads(self) -> list[str]:
        used = {d for c in self.known.values() for d in c.deps}
        return sorted(h for h in self.known if h not in used)

    def ancestors(self, heads: Iterable[str]) -> set[str]:
        seen: set[str] = set()
        stack = [h for h in heads if h in self.known]
        while stack:
            h = stack.pop()
            if h not in seen:
                seen.add(h)
                stack += self.known[h].deps
        return seen

    def missing(self, heads: Iterable[str]) -> list[str]:
        asked = {d for c in self.waiting.values() for d in c.deps} | set(heads)
        return sorted(h for h in asked if h not in self.known and h not in self.waiting)

    def since(self, heads: Iterable[str]) -> list[Change]:
        old = self.ancestors(heads)
        return [c for h, c in self.known.items() if h not in old]

    def to_send(self, have: list[Have], need: list[str]) -> list[str]:
        if not have:
            return list(need)
        fresh = self.since({h for x in have for h in x.last_sync})
        raw = [bytes.fromhex(c.hash) for c in fresh]
        send = {c.hash for c, *held in zip(fresh, *(x.bloom.contains(raw) for x in have)) if not any(held)}
        for c in fresh:  # known changes are in an order in which dependents come later
            if any(d in send for d in c.deps):
                send.add(c.hash)
        return [h for h in need if h not in send] + [c.hash for c in fresh if c.hash in send]


def generate(doc: Replica, state: State) -> Message | None:
    """The next message to a peer, or None if there is nothing to say or an answer is awaited."""
    heads, need = doc.heads(), doc.missing(state.their_heads or [])
    have = []
    if set(need) <= set(state.their_heads or []):
        have = [Have(sorted(state.shared_heads), BloomFilter.of(bytes.fromhex(c.hash) for c in doc.since(state.shared_heads)))]
    if state.their_have and not all(h in doc.known for h in state.their_have[0].last_sync):
        return Message(heads, [], [Have()], [], list(CAPABILITIES))
    chunks: list[bytes] = []
    hashes: list[str] = []
    version = MESSAGE_V1
    if state.their_have is not None and state.their_need is not None:
        newer = 2 in (state.their_capabilities or [])
        hashes = [h for h in doc.to_send(state.their_have, state.their_need) if h not in state.sent and h in doc.known]
        if newer and doc.known and (state.their_heads == [] or len(hashes) > len(doc.known) // 3) and hashes:
            hashes, version = list(doc.known), MESSAGE_V2
            chunks = [encode_document(list(doc.known.values()))]
        else:
            chunks = [encode_change(doc.known[h], deflate=True)[0] for h in hashes]
    if state.last_sent_heads == heads and ((state.their_heads == heads and not chunks) or state.in_flight):
        return None
    state.last_sent_heads = heads
    state.sent |= set(hashes)
    state.in_flight = True
    return Message(heads, need, have, chunks, list(CAPABILITIES), version)


def receive(doc: Replica, state: State, message: Message) -> None:
    """Takes in a peer's message: its changes, what it has and needs, and what both share now."""
    before = doc.heads()
    state.in_flight = False
    doc.apply(c for data in message.changes for c in decode(data))
    after = doc.heads()
    state.their_have, state.their_heads, state.their_need = message.have, message.heads, message.need
    state.their_capabilities = message.capabilities
    shared = {h for h in message.heads if h in doc.known}
    if shared == set(message.heads):
        state.shared_heads = sorted(shared)
        state.sent &= set(doc.known)
    elif message.changes:
        state.shared_heads = sorted({h for h in after if h not in before} | {h for h in state.shared_heads if h in after})
    else:
        state.shared_heads = sorted(set(state.shared_heads) | shared)
    if not message.heads:  # the peer has nothing, or has lost what it had
        state.last_sent_heads, state.sent, state.shared_heads = None, set(), []
    held = doc.ancestors(message.heads)
    state.sent -= held
