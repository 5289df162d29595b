"""Exactly-once reading of at-least-once deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import clean_changes

_NATURAL = ["doc_id", "actor", "seq"]


def first_deliveries(changes: DataFrame) -> DataFrame:
    """``hash`` and ``row``: one row per distinct change, ``row`` its first delivery with all columns in clean form.

    Deliveries with equal hashes are the same change; one without a hash is the change with the
    same ``doc_id``, ``actor`` and ``seq`` (of several, the one delivered first).  A delivery
    without a hash of which one of those three is null too is a change of its own.  ``hash`` is null if no
    delivery of the change had it.

    Two aggregations by ``min_by`` over (``delivery_id``, the rest of the identity): by the three columns, which
    finds the hash that deliveries without one belong to and the first of these; then by hash.  Both
    combine on the map side, so a change delivered any number of times is a row per map task, and
    the row travels with its order: nothing is joined back.
    """
    c = clean_changes(changes)
    row = F.struct(*[F.col(f"`{x}`") for x in c.columns])
    d = c.select(F.col("hash").alias("_h"), *[F.col(k).alias(f"_{k}") for k in _NATURAL], F.struct("delivery_id", "hash", *_NATURAL).alias("_order"), row.alias("_row"))
    natural = [f"_{k}" for k in _NATURAL]
    named = F.col("_h").isNotNull()
    whole = ~F.greatest(*[F.col(k).isNull() for k in natural])
    by_natural = (
        d.where(whole)
        .groupBy(*natural)
        .agg(
            F.min_by("_h", F.when(named, F.col("_order"))).alias("_owner"),
            F.min_by("_row", F.when(~named, F.col("_order"))).alias("_row"),
            F.min(F.when(~named, F.col("_order"))).alias("_order"),
        )
        .where(F.col("_order").isNotNull())
    )
    own = F.struct(*natural)
    bare = by_natural.select(F.col("_owner").alias("_h"), F.when(F.col("_owner").isNull(), own).alias("_own"), "_order", "_row")
    hashed = d.where(named).select("_h", F.when(F.lit(False), own).alias("_own"), "_order", "_row")
    first = hashed.unionByName(bare).groupBy("_h", "_own").agg(F.min_by("_row", "_order").alias("_row"))
    alone = d.where(~named & ~whole).select("_h", "_row")
    return first.select("_h", "_row").unionByName(alone).toDF("hash", "row")


def keep_first(changes: DataFrame) -> DataFrame:
    """The kept delivery of each distinct change, with all columns of ``changes`` in clean form.

    ``hash`` is filled where another delivery of the change had it.  Extra columns pass through.
    """
    kept = first_deliveries(changes)
    return kept.select(*[F.col("hash") if c == "hash" else F.col("row").getField(c).alias(c) for c in changes.columns])


def with_hashes(changes: DataFrame) -> DataFrame:
    """Every delivery in clean form, those without a hash with that of the change they belong to (null if it has none).

    Only deliveries that share ``doc_id``, ``actor`` and ``seq`` with one without a hash are looked at.
    """
    c = clean_changes(changes)
    named, bare = c.where(F.col("hash").isNotNull()), c.where(F.col("hash").isNull())
    wanted = bare.select(*_NATURAL).dropna().distinct()
    owner = (
        named.select("delivery_id", "hash", *_NATURAL)
        .join(wanted, _NATURAL, "left_semi")
        .groupBy(*_NATURAL)
        .agg(F.min_by("hash", F.struct("delivery_id", "hash")).alias("_owner"))
    )
    found = bare.join(owner, _NATURAL, "left").withColumn("hash", F.col("_owner")).select(*c.columns)
    return named.unionByName(found)


def further_copies(changes: DataFrame) -> DataFrame:
    """``delivery_id`` of every delivery of a change after its first."""
    kept = keep_first(changes.select("delivery_id", "hash", *_NATURAL)).select("delivery_id")
    return changes.select("delivery_id").join(kept, "delivery_id", "left_anti")


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Exactly one whole row for each key: the least by ``order``, then by the row itself.

    An aggregation of ``min_by`` over a struct; equal rows, nulls and ties can't give two.
    Columns of map or variant type can't be compared and are not allowed beside the order.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    best = F.min_by(row, F.struct(*[F.col(c) for c in order], row))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best.alias("_row")).select("_row.*")
