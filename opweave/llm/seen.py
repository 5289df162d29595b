"""Has this key been seen before?  Quotient filters over billions of earlier keys, in shards."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quotient

LOAD = 0.75
KEYS_PER_SHARD = 200_000
REMAINDER_BITS = 24
#: Stretches of records, in order of arrival, each of which has a filter of its own.
RANGES = 8
FILTER_SCHEMA = "shard int, payload binary"


@dataclass(frozen=True)
class Geometry:
    """How 64-bit key hashes are cut: ``s`` bits of shard, ``q`` of quotient, ``r`` of remainder."""

    s: int
    q: int
    r: int

    def __post_init__(self):
        if self.s + self.q + self.r > 62:
            raise ValueError(f"{self.s + self.q + self.r} bits of fingerprint wanted, 62 are there: take fewer remainder bits")

    @classmethod
    def for_keys(cls, n: int, r: int = REMAINDER_BITS, keys_per_shard: int = KEYS_PER_SHARD) -> Geometry:
        s = max(4, math.ceil(math.log2(max(1, n / keys_per_shard))))
        q = max(4, math.ceil(math.log2(max(1, n) / LOAD / 2**s)))
        return cls(s, q, r)

    @property
    def shards(self) -> int:
        return 1 << self.s

    def false_rate(self, n: float) -> float:
        """The chance that a new key has the fingerprint of one of ``n`` others."""
        return -math.expm1(-n / 2.0 ** (self.s + self.q + self.r))


def fingerprints(df: DataFrame, key: str, g: Geometry) -> DataFrame:
    """Adds ``shard`` and ``fp``.  The hash is over the whole key, so keys that differ in a character don't lie together."""
    h = F.xxhash64(key)
    keep = g.q + g.r
    fp = F.shiftrightunsigned(h, 64 - g.s - keep).bitwiseAND(F.lit((1 << keep) - 1))
    return df.withColumns({"shard": F.shiftrightunsigned(h, 64 - g.s).cast("int"), "fp": fp})


def _distinct_fingerprints(keys: DataFrame, key: str, g: Geometry) -> DataFrame:
    return fingerprints(keys.select(F.col(key).alias("k")).where(F.col("k").isNotNull()), "k", g).select("shard", "fp").distinct()


def build_filters(keys: DataFrame, key: str, g: Geometry) -> DataFrame:
    """One filter for each shard that has keys.  Null keys are left out; repeats cost nothing.

    Only distinct 8-byte fingerprints are shuffled, and a shard holds about ``KEYS_PER_SHARD`` of
    them, whatever the number of keys.
    """
    q, r = g.q, g.r

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "payload": [quotient.encode(pdf["fp"].to_numpy(), q, r)]})

    return _distinct_fingerprints(keys, key, g).groupBy("shard").applyInPandas(pack, FILTER_SCHEMA)


def merge_filters(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filters of both sides' keys, shard by shard."""

    def pair(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        both = [*x.itertuples(index=False), *y.itertuples(index=False)]
        payload = both[0].payload
        for other in both[1:]:
            payload = quotient.merge(payload, other.payload)
        return pd.DataFrame({"shard": [both[0].shard], "payload": [payload]})

    return a.groupBy("shard").cogroup(b.groupBy("shard")).applyInPandas(pair, FILTER_SCHEMA)


def filter_stats(filters: DataFrame) -> DataFrame:
    """``shard``, ``n_keys`` (distinct fingerprints) and ``n_bytes`` of each filter."""

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                {"shard": b["shard"], "n_keys": [quotient.size(p) for p in b["payload"]], "n_bytes": [len(p) for p in b["payload"]]}
            )

    return filters.mapInPandas(stats, "shard int, n_keys bigint, n_bytes bigint")


class SeenBefore:
    """Decides for each record whether its key is among ``earlier`` keys or on an earlier record, from filters alone.

    ``records`` have a unique ``id`` in order of arrival.  Keys are compared as given; a null key
    was never seen, and neither is a record without an id.  Records are cut into ``RANGES`` stretches of ids.  In each shard the filter of
    the earlier keys is probed with the first stretch, merged with that stretch's own filter, probed
    with the next, and so on; within a stretch the order of ids decides.  Only 8-byte fingerprints
    (distinct for each stretch, with the least id) are shuffled, so a key on a third of all records is no hot
    spot, and a task holds one shard's filter.

    A seen key is never missed.  A new key is taken for a seen one if it has the fingerprint of
    another: :meth:`errors` derives and measures that rate.  Making an object counts both sides
    (two jobs); everything else is lazy.
    """

    def __init__(self, records: DataFrame, earlier: DataFrame, id: str, key: str, r: int = REMAINDER_BITS, ranges: int = RANGES):
        self.records = records.select(F.col(id).alias("id"), F.col(key).alias("key")).where(F.col("key").isNotNull() & F.col("id").isNotNull())
        self.earlier = earlier.select(F.col(key).alias("key")).where(F.col("key").isNotNull())
        self.id = id
        self.n_earlier = earlier.count()
        grid = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
        self.n_records, borders = self.records.agg(F.count("id"), F.percentile_approx("id", grid, 1000)).first()
        self.geometry = g = Geometry.for_keys(self.n_earlier + self.n_records, r)
        borders = sorted(set(borders or []))
        stretch = sum((F.col("id") > b).cast("int") for b in borders) if borders else F.lit(0)
        firsts = fingerprints(self.records, "key", g).withColumn("stretch", stretch).groupBy("shard", "fp", "stretch").agg(F.min("id").alias("id"))
        q = g.q

        def walk(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            payload = quotient.encode(old["fp"].to_numpy(), q, r)
            new = []
            for _, part in rows.groupby("stretch", sort=True):
                fps = part["fp"].to_numpy()
                new.append(part["id"].to_numpy()[~quotient.probe(payload, fps)])
                payload = quotient.merge(payload, quotient.encode(fps, q, r))
            return pd.DataFrame({"id": np.concatenate(new) if new else np.zeros(0, np.int64)})

        old = _distinct_fingerprints(self.earlier, "key", g)
        self.new = old.groupBy("shard").cogroup(firsts.groupBy("shard")).applyInPandas(walk, "id bigint")

    def found(self) -> DataFrame:
        """The ids of records whose keys the filters hold from before."""
        return self.records.select("id").join(self.new, "id", "left_anti").select(F.col("id").alias(self.id))

    def wrong(self) -> DataFrame:
        """The ids of records found though their key is new, by comparing all keys: a measurement, not a part of :meth:`found`."""
        true = self.records.groupBy("key").agg(F.min("id").alias("id")).join(self.earlier.distinct(), "key", "left_anti")
        return true.select("id").join(self.new, "id", "left_anti")

    def errors(self) -> DataFrame:
        """One row: how many records were found, how many of them wrongly, the rate of that among new keys, and the rate that the geometry lets expect."""
        g = self.geometry
        n_new = self.new.agg(F.count("id").alias("n_new")).scalar()
        n_wrong = self.wrong().agg(F.count("id").alias("n_wrong")).scalar()
        return self.found().agg(F.count(self.id).alias("n_found")).select(
            F.lit(self.n_earlier).cast("bigint").alias("n_earlier"),
            F.lit(self.n_records).cast("bigint").alias("n_records"),
            "n_found",
            n_wrong.alias("n_wrong"),
            (n_wrong / F.greatest(n_wrong + n_new, F.lit(1))).alias("measured_rate"),
            F.lit(g.false_rate(self.n_earlier + self.n_records / 2)).alias("derived_rate"),
            F.lit(g.r).alias("remainder_bits"),
        )
