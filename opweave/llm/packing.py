"""Filling fixed-capacity containers with whole texts: bounded-space online best-fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: A fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 2048
OPEN_BINS = 256
DOCS_PER_SHARD = 20_000

_encoders: dict = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(df: DataFrame, id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``id`` and ``n_tokens`` of each row's whole text; a null or empty text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    kind = df.select(id).schema[0].dataType.simpleString()
    return df.select(F.col(id).alias("id"), text).mapInArrow(count, f"id {kind}, n_tokens bigint")


class BestFit:
    """Containers filled online, of which at most ``open_bins`` are open.

    A bitset has a bit for each amount of free space some open container has.  An item goes to the
    least free space that takes it (the lowest set bit from its size up), else to a new container;
    when too many are open the fullest (the lowest set bit) is closed.  A full one closes at once.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.n_open, self.n_bins = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        same = self.by_free[free]
        number = same.pop()
        if not same:
            self.bits ^= 1 << free
        self.n_open -= 1
        return number

    def _keep(self, number: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(number)
            self.bits |= 1 << free
            self.n_open += 1

    def new(self) -> int:
        self.n_bins += 1
        return self.n_bins - 1

    def place(self, size: int) -> tuple[int, int]:
        """The container for an item of ``size`` and the place where the item starts in it."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.new(), self.capacity
        self._keep(number, free - size)
        return number, self.capacity - free


def pack_sizes(sizes: np.ndarray, capacity: int, open_bins: int) -> tuple[list, list, list, list, list]:
    """(item, piece, container, start, size) lists: only items above ``capacity`` are split, into full containers and a rest."""
    fit = BestFit(capacity, open_bins)
    item, piece, container, start, size = [], [], [], [], []

    def put(i: int, p: int, c: int, at: int, n: int) -> None:
        item.append(i), piece.append(p), container.append(c), start.append(at), size.append(n)

    for i, n in enumerate(sizes.tolist()):
        p = 0
        while n > capacity:
            put(i, p, fit.new(), 0, capacity)
            n, p = n - capacity, p + 1
        c, at = fit.place(n)
        put(i, p, c, at, n)
    return item, piece, container, start, size


def pack(
    items: DataFrame,
    id: str,
    size: str,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    docs_per_shard: int = DOCS_PER_SHARD,
    n_items: int | None = None,
) -> DataFrame:
    """``id``, ``piece_no``, ``container_id``, ``start`` (in the container), ``n_tokens``: every item in containers of ``capacity``.

    Items are dealt to shards by the hash of their id and packed there in the order of ids as text, so the
    result doesn't depend on how the input was split.  A shard leaves at most ``open_bins``
    containers open; the share of these falls with ``docs_per_shard``.  ``n_items`` is how many there are, if
    that is known more cheaply than by counting ``items``, which may tokenise every text for it.  Items of size 0 (or null) take
    no room but get a place.  ``container_id`` is the shard times 2^32 plus a number in the shard.
    """
    kind = items.select(id).schema[0].dataType.simpleString()
    shards = max(1, -(-(items.count() if n_items is None else n_items) // docs_per_shard))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable", ignore_index=True)
        item, piece, container, start, n = pack_sizes(pdf["n"].to_numpy(np.int64), capacity, open_bins)
        at = np.asarray(item, dtype=np.int64)
        return pd.DataFrame(
            {
                "id": pdf["id"].to_numpy()[at],
                "piece_no": np.asarray(piece, dtype=np.int32),
                "container_id": np.asarray(container, dtype=np.int64) + (int(pdf["shard"].iloc[0]) << 32),
                "start": np.asarray(start, dtype=np.int32),
                "n_tokens": np.asarray(n, dtype=np.int32),
            }
        )

    sharded = items.select(
        F.col(id).cast("string").alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"),
        F.pmod(F.xxhash64(id), F.lit(shards)).cast("int").alias("shard"),
    )
    out = sharded.repartition(shards, "shard").groupBy("shard").applyInPandas(
        fill, "id string, piece_no int, container_id bigint, start int, n_tokens int"
    )
    return out.withColumns({"id": F.col("id").cast(kind)}).withColumnRenamed("id", id)
