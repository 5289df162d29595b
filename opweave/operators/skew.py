"""Per-key results where a few keys hold most rows.

The rows are first counted by key *and* value (a partial aggregation on the map side turns any
number of equal rows into one weighted row), so that what is shuffled by key no longer depends on
how often a key occurs.  Distinct counts, modes and percentiles then come from weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str, weight: str = "weight") -> DataFrame:
    """One row per (keys, value) with the number of its rows in ``weight``.

    Null keys and null values are groups of their own.
    """
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(weight))


def key_profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows, distinct values and mode of ``value`` for each key, by value-frequency compression.

    Columns: keys, ``n_rows`` (null values count), ``n_distinct`` (they don't), ``mode_value`` (null
    if the key has only null values; the least of the most frequent on ties), ``mode_rows``.
    Rows with a null key form a group; an empty table gives no rows.
    """
    freq = value_frequencies(df.select(*keys, F.col(value).alias("_v")), keys, "_v", "_w")
    top = F.min_by(F.struct("_v", "_w"), F.when(F.col("_v").isNotNull(), F.struct(-F.col("_w"), F.col("_v"))))
    return (
        freq.groupBy(*keys)
        .agg(F.sum("_w").alias("n_rows"), F.count("_v").alias("n_distinct"), top.alias("_top"))
        .select(*keys, "n_rows", "n_distinct", F.col("_top._v").alias("mode_value"), F.col("_top._w").alias("mode_rows"))
    )


def key_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], slices: int = 256
) -> DataFrame:
    """Exact discrete percentiles of ``value`` for each key: the least value that at least the share ``p`` of the rows doesn't exceed.

    Each key's distinct values are cut into at most ``slices`` ranges at approximate quantiles (a
    sketch of bounded size), range totals say which range holds a percentile, and only within a
    range are values ordered; so no task orders all values of a large key.
    Columns: keys and ``p<percent>`` for each of ``at``.  Null values don't count; a key without
    others gives no row.
    """
    freq = value_frequencies(df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull()), keys, "_v", "_w")
    grid = [i / slices for i in range(1, slices)]
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    splits = freq.groupBy(*keys).agg(F.percentile_approx("_v", grid, slices * 16).alias("_s"), F.sum("_w").alias("_n"))
    sliced = (
        freq.alias("f")
        .join(splits.alias("s"), on)
        .select(
            *[F.col(f"f.{k}").alias(k) for k in keys],
            "_v",
            "_w",
            "_n",
            F.size(F.filter(F.array_distinct("_s"), lambda s: s < F.col("_v"))).alias("_slice"),
        )
    )
    by_key = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_w").alias("_t"), F.first("_n").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_t").over(by_key), F.lit(0)))
    )
    targets = [(f"p{round(p * 100)}", F.greatest(F.ceil(F.lit(p) * F.col("_n")), F.lit(1))) for p in at]
    holds = F.array(*[F.struct(F.lit(n).alias("name"), t.alias("target")) for n, t in targets])
    wanted = before.withColumn(
        "_targets",
        F.filter(holds, lambda h: (h["target"] > F.col("_before")) & (h["target"] <= F.col("_before") + F.col("_t"))),
    ).where(F.size("_targets") > 0)
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = (
        sliced.alias("f")
        .join(wanted.alias("s"), [*on, F.col("f._slice") == F.col("s._slice")])
        .select(*[F.col(f"f.{k}").alias(k) for k in keys], "f._slice", "_v", "_w", "_before", "_targets")
        .withColumn("_cum", F.col("_before") + F.sum("_w").over(in_slice))
        .select(*keys, "_v", "_cum", F.explode("_targets").alias("_target"))
        .where(F.col("_cum") >= F.col("_target.target"))
    )
    return hit.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_target.name") == n, F.col("_v"))).alias(n) for n, _ in targets]
    )


def heavy_keys(df: DataFrame, keys: Sequence[str], value: str, one_in: int = 25) -> DataFrame:
    """Profiles of the keys that hold at least one in ``one_in`` of all rows of ``df``.

    A key with a null part is none.  The total is a scalar subquery that reads no column.
    """
    profile = key_profile(df, keys, value)
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    known = [F.col(k).isNotNull() for k in keys]
    return profile.where((F.col("n_rows") * one_in >= total)).where(F.array_min(F.array(*known)))
