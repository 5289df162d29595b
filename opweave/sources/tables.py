"""The operation-log tables as parquet, with their identifiers made comparable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "_root"
HEAD = "_head"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_id(c: Column | str) -> Column:
    """Lower case, without surrounding blanks; an empty identifier is null."""
    c = F.col(c) if isinstance(c, str) else c
    stripped = F.lower(F.btrim(c, F.lit(" \t\r\n\u00a0")))
    return F.when(stripped != "", stripped)


def clean_op(c: Column | str) -> Column:
    """An id struct with its actor in comparable form; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.struct(c["ctr"].alias("ctr"), F.lower(F.trim(c["actor"])).alias("actor")))


def id_text(c: Column | str, root: str = ROOT) -> Column:
    """``ctr@actor`` of an id struct; ``ctr`` 0 is the root object (or a sequence's head)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c["ctr"] == 0, F.lit(root)).when(
        c.isNotNull(), F.concat(c["ctr"].cast("string"), F.lit("@"), F.lower(F.trim(c["actor"])))
    )


def clean_changes(changes: DataFrame) -> DataFrame:
    """``changes`` with ``hash``, ``actor`` and ``deps``, so far as it has them, in comparable form."""
    out = changes.withColumns({c: clean_id(c) for c in ("hash", "actor") if c in changes.columns})
    if "deps" in changes.columns:
        deps = F.transform(F.coalesce("deps", F.array().cast("array<string>")), clean_id)
        out = out.withColumn("deps", F.filter(F.array_distinct(deps), lambda d: d.isNotNull()))
    return out
