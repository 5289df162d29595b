"""Held-out passages inside a training corpus, by suffix arrays over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .words import words

MIN_WORDS = 8
SHARD_WORDS = 1_000_000
ITEMS_PER_BLOCK = 20_000
HITS_AT_ONCE = 1_000_000

_MATCHES = "item_id bigint, side string, n_words int, item_word int, doc_word int"


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` ordered by the ``depth`` or more codes that start there (prefix doubling).

    A position near the end sorts before longer ones with the same start.
    """
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth and n:
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        if new[order[-1]] == n:
            break
        rank, k = new, 2 * k
    return order


def _compare(codes: np.ndarray, at: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """-1, 0, 1 as the codes at each position are below, begin with, or are above the pattern."""
    out = np.zeros(len(at), dtype=np.int8)
    for j in range(patterns.shape[1]):
        live = np.flatnonzero(out == 0)
        if not len(live):
            break
        pos = at[live] + j
        here = np.where(pos < len(codes), codes[np.minimum(pos, len(codes) - 1)], -2)
        out[live] = np.sign(here - patterns[live, j])
    return out


def search(codes: np.ndarray, order: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern (a row) the range of ``order`` whose suffixes begin with it: two binary searches, all patterns at once."""
    bounds = []
    for side in (0, 1):
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order), np.int64)
        while len(go := np.flatnonzero(lo < hi)):
            mid = (lo[go] + hi[go]) // 2
            less = _compare(codes, order[mid], patterns[go]) < side
            lo[go[less]] = mid[less] + 1
            hi[go[~less]] = mid[~less]
        bounds.append(lo)
    return bounds[0], bounds[1]


class Passages:
    """The held-out items of a block as patterns: every suffix of either side with ``least`` words or more."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], least: int):
        self.least = least
        self.owner: list[tuple[int, str]] = []
        texts: list[list[str]] = []
        for item_id, src, ref in items:
            for side, text in (("src", src), ("ref", ref)):
                w = words(text)
                if len(w) >= least:
                    self.owner.append((item_id, side))
                    texts.append(w)
        flat = [w for t in texts for w in t]
        codes, vocabulary = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
        self.codes = np.append(codes.astype(np.int64), -3)  # ends differ from every word and border of a corpus
        self.vocabulary = pd.Index(vocabulary)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        counts = np.maximum(lengths - least + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.start = starts[self.text] + self.offset
        self.left = lengths[self.text] - self.offset
        self.depth = int(lengths.max(initial=least))

    def patterns(self) -> np.ndarray:
        return self.codes[self.start[:, None] + np.arange(self.least)[None, :]]


def _stretches(hits: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of patterns with hits, of about ``HITS_AT_ONCE`` hits each."""
    total = np.concatenate([[0], np.cumsum(hits)])
    a = 0
    while a < len(hits) and total[-1] > total[a]:
        b = max(a + 1, int(np.searchsorted(total, total[a] + HITS_AT_ONCE, side="right")) - 1)
        if total[b] > total[a]:
            yield a, b
        a = b


def _maximal(p: Passages, codes, doc, word, order, lo, hi, first: int) -> pd.DataFrame:
    """The matches of patterns from number ``first`` that can't be made longer to the left, as long as they go to the right."""
    hits = hi - lo
    q = np.repeat(np.arange(len(lo)), hits)
    pos = order[np.repeat(lo, hits) + np.arange(len(q)) - np.repeat(np.cumsum(hits) - hits, hits)]
    q = q + first
    inner = (p.offset[q] > 0) & (pos > 0)
    inner[inner] = codes[pos[inner] - 1] == p.codes[p.start[q[inner]] - 1]
    q, pos = q[~inner], pos[~inner]
    n = np.full(len(q), p.least, dtype=np.int64)
    live = np.arange(len(q))
    while len(live):  # lengthen every match as far as it goes
        more = (n[live] < p.left[q[live]]) & (pos[live] + n[live] < len(codes))
        live = live[more]
        live = live[codes[pos[live] + n[live]] == p.codes[p.start[q[live]] + n[live]]]
        n[live] += 1
    return pd.DataFrame({"doc": doc[pos], "text": p.text[q], "n_words": n, "item_word": p.offset[q], "doc_word": word[pos]})


def _shard_matches(p: Passages, doc_ids: list, texts: list[list[str]]) -> pd.DataFrame:
    """All matches of one shard of the corpus that can't be made longer."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.array([w for t in texts for w in t], dtype=object)
    none = pd.DataFrame({c.split()[0]: [] for c in f"doc_id any, {_MATCHES}".split(", ")})
    if not len(flat) or not len(p.start):
        return none
    # words that no item has end every match, so suffixes are kept only inside runs of the items' words
    codes = p.vocabulary.get_indexer(flat).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    word = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = codes >= 0
    edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])])
    run = np.cumsum(edge) - 1
    keep = np.flatnonzero(inside & (np.bincount(run)[run] >= p.least))
    if not len(keep):
        return none
    borders = np.flatnonzero(np.concatenate([run[keep][1:] != run[keep][:-1], [True]])) + 1
    codes, doc, word = (np.insert(x[keep], borders, fill) for x, fill in ((codes, -1), (doc, -1), (word, -1)))
    order = suffix_array(codes, p.depth)
    lo, hi = search(codes, order, p.patterns())
    parts = [_maximal(p, codes, doc, word, order, lo[a:b], hi[a:b], a) for a, b in _stretches(hi - lo)]
    found = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"doc": []})
    if not len(found):
        return none
    owner = [p.owner[t] for t in found["text"]]
    return pd.DataFrame(
        {
            "doc_id": pd.Series([doc_ids[d] for d in found["doc"]], dtype=object),
            "item_id": [o[0] for o in owner],
            "side": [o[1] for o in owner],
            "n_words": found["n_words"].astype("int32"),
            "item_word": found["item_word"].astype("int32"),
            "doc_word": found["doc_word"].astype("int32"),
        }
    )


def _batch(found: pd.DataFrame, id_kind: pa.DataType) -> pa.RecordBatch:
    kinds = {"doc_id": id_kind, "item_id": pa.int64(), "side": pa.string(), "n_words": pa.int32(), "item_word": pa.int32(), "doc_word": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(found[c].tolist(), k) for c, k in kinds.items()], names=list(kinds))


def leaked_passages(
    documents: DataFrame, items: DataFrame, least: int = MIN_WORDS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Every verbatim match of documents with a side of an item, of ``least`` words or more, that can't be made longer.

    ``documents``: ``doc_id``, ``text``.  ``items``: ``item_id``, ``src_text``, ``ref_text``.  Returns ``doc_id``,
    ``item_id``, ``side``, ``n_words``, and the first word of the match in the item and in the document.
    Case, accents, punctuation, white space and invisible characters don't matter.  Null and empty
    texts match nothing; sides of fewer than ``least`` words can't leak.

    The corpus is read once per block of ``ITEMS_PER_BLOCK`` items, which bounds what the driver and a worker
    hold of the items: where there are several blocks, each is run and its matches written before the next is
    read.  Workers gather whole documents to shards of about ``shard_words`` words, build each
    shard's suffix array and look up every suffix of every item by binary search.  Nothing is shuffled.
    """
    n_items = items.count()
    id_kind = documents.select("doc_id").schema[0].dataType.simpleString()
    out = None
    n_blocks = max(1, -(-n_items // ITEMS_PER_BLOCK))
    rows = items.select("item_id", "src_text", "ref_text").orderBy("item_id").toLocalIterator()
    for _ in range(n_blocks):
        block = [tuple(r) for _, r in zip(range(ITEMS_PER_BLOCK), rows)]

        def match(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            passages = Passages(block, least)
            ids: list = []
            texts: list[list[str]] = []
            size, kind = 0, None
            for b in batches:
                kind = b.column(0).type
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids.append(doc_id)
                    texts.append(words(text))
                    size += len(texts[-1])
                    if size >= shard_words:
                        yield _batch(_shard_matches(passages, ids, texts), kind)
                        ids, texts, size = [], [], 0
            if ids:
                yield _batch(_shard_matches(passages, ids, texts), kind)

        part = documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(match, f"doc_id {id_kind}, {_MATCHES}")
        part = cut(part) if n_blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def longest_matches(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The longest of :func:`leaked_passages` for each document and side of an item (of equal ones the first in the item, then in the document)."""
    place = F.struct("n_words", "item_word", "doc_word")
    order = F.struct(F.col("n_words"), -F.col("item_word"), -F.col("doc_word"))
    best = leaked_passages(documents, items, least).groupBy("doc_id", "item_id", "side").agg(F.max_by(place, order).alias("_best"))
    return best.select("doc_id", "item_id", "side", "_best.*")


def leaks(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``item_id`` of every document that holds a passage of an item."""
    return leaked_passages(documents, items, least).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The documents, with all their columns, that hold no passage of an item."""
    affected = leaks(documents, items, least).select(F.col("doc_id").alias("_leaked")).distinct()
    return documents.join(affected, F.col("doc_id").eqNullSafe(F.col("_leaked")), "left_anti")
