"""Operation logs in runs: what was typed in one go is one row, however long.

A log in runs has the columns of operations and ``run_n``.  A row with ``run_n`` > 1 stands for ``run_n`` inserts of one
actor with the counters from ``op.ctr`` on: the first follows ``elem``, each other one the insert before it, and
``val.s`` has their code points, one each.  Other rows have ``run_n`` = 1.  :func:`expand` says what a log in runs means.

Runs are cut only where another operation names something in them, so that order, visibility and marks
work on pieces; the texts stay where they are until :func:`fill` puts them into the items at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters are cut in stretches of this many, so no list of cuts and no string searched in grows with its run.
STRETCH = 4096


def _stretch(ctr: Column) -> Column:
    return F.floor(ctr / STRETCH).cast("bigint")


def _bounds() -> tuple[Column, Column]:
    """The part of a run that lies in ``stretch``: first counter, counter after the last."""
    ctr, n, at = F.col("op.ctr"), F.col("run_n"), F.col("stretch")
    return F.greatest(ctr, at * STRETCH), F.least(ctr + n, (at + 1) * STRETCH)


def _stretches(log: DataFrame) -> DataFrame:
    """The runs of ``log``, a row for each stretch of counters that they touch."""
    ctr, n = F.col("op.ctr"), F.col("run_n")
    return log.where(n > 1).withColumn("stretch", F.explode(F.sequence(_stretch(ctr), _stretch(ctr + n - 1))))


def expand(log: DataFrame) -> DataFrame:
    """The operations of a log in runs, a row for each."""
    rows = log.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("run_n") - 1)))
    i, ctr, actor = F.col("_i"), F.col("op.ctr"), F.col("op.actor")
    ident = lambda c: F.struct(c.alias("ctr"), actor.alias("actor"))
    return rows.withColumns({
        "op": ident(ctr + i),
        "elem": F.when(i == 0, F.col("elem")).otherwise(ident(ctr + i - 1)),
        "val": F.when(F.col("run_n") == 1, F.col("val")).otherwise(F.col("val").withField("s", F.substring(F.col("val.s"), (i + 1).cast("int"), F.lit(1)))),
    }).drop("_i", "run_n")


def pieces(log: DataFrame) -> DataFrame:
    """The log with its runs cut wherever an operation names or begins or ends within them: columns of ``log`` and ``run``.

    ``op`` and ``run_n`` are those of the piece, ``run`` is the first operation of the run it is of (null: none).  Pieces of
    runs have no ``val.s``.  After this an operation named by another is a row of its own, or the last of its row.
    """
    cols = log.columns
    ctr, actor, elem, n = F.col("op.ctr"), F.col("op.actor"), F.col("elem"), F.col("run_n")
    at = lambda a, c: F.struct(a.alias("actor"), c.cast("bigint").alias("ctr"))
    around = lambda i: F.array(at(i["actor"], i["ctr"]), at(i["actor"], i["ctr"] + 1))
    none = F.expr("array()").cast("array<struct<actor:string,ctr:bigint>>")
    ids = F.expr("array()").cast("array<struct<ctr:bigint,actor:string>>")
    named = F.concat(
        F.array(at(actor, ctr), at(actor, ctr + n)),
        F.when(elem.isNull(), none).when(F.col("is_insert"), F.array(at(elem["actor"], elem["ctr"] + 1))).otherwise(around(elem)),
        F.flatten(F.transform(F.filter(F.coalesce("pred", ids), lambda p: p.isNotNull()), around)),
    )
    # a stretch gathers its cuts and the parts of runs in it, so the log is read and shuffled once for both
    part = F.struct(*[(F.col("val").withField("s", F.lit(None).cast("string")) if c == "val" else F.col(c)).alias(c) for c in cols if c != "doc_id"])
    no_part = F.lit(None).cast(log.select(part.alias("r")).schema["r"].dataType)
    of_cuts = F.transform(named, lambda c: F.struct(c["actor"].alias("actor"), _stretch(c["ctr"]).alias("stretch"), c["ctr"].alias("cut"), no_part.alias("part")))
    touched = F.when(n > 1, F.sequence(_stretch(ctr), _stretch(ctr + n - 1))).otherwise(F.array().cast("array<bigint>"))
    of_runs = F.transform(touched, lambda s: F.struct(actor.alias("actor"), s.alias("stretch"), F.lit(None).cast("bigint").alias("cut"), part.alias("part")))
    gathered = (
        log.select("doc_id", F.inline(F.concat(of_cuts, of_runs)).alias("actor", "stretch", "cut", "part"))
        .groupBy("doc_id", "actor", "stretch").agg(F.collect_set("cut").alias("cuts"), F.collect_set("part").alias("parts"))
    )
    low, high = _bounds()
    parts = gathered.select("doc_id", "actor", "stretch", "cuts", F.inline("parts")).withColumns({"_low": low, "_high": high})
    inner = F.filter("cuts", lambda c: (c > F.col("_low")) & (c < F.col("_high")))
    starts = F.array_sort(F.concat(F.array("_low"), inner))
    steps = F.transform("_starts", lambda s, i: F.struct(s.alias("_ctr"), (F.coalesce(F.get(F.col("_starts"), i + 1), F.col("_high")) - s).alias("_n")))
    cut = parts.withColumn("_starts", starts).select("*", F.inline(steps).alias("_ctr", "_n"))
    ident = lambda c: F.struct(c.alias("ctr"), F.col("actor").alias("actor"))
    new = {
        "op": ident(F.col("_ctr")),
        "elem": F.when(F.col("_ctr") == ctr, elem).otherwise(ident(F.col("_ctr") - 1)),
        "run_n": F.col("_n"),
    }
    whole = log.where(n == 1).select(*cols, F.lit(None).cast("struct<ctr:bigint,actor:string>").alias("run"))
    return whole.unionByName(cut.select(*[new.get(c, F.col(c)).alias(c) for c in cols], F.col("op").alias("run")))


def fill(items: DataFrame, log: DataFrame) -> DataFrame:
    """``items`` (with ``op``, ``run_n``, ``run``) that have no ``s`` with their code points of the runs of ``log``."""
    low, high = _bounds()
    text = F.substring(F.col("val.s"), (low - F.col("op.ctr") + 1).cast("int"), (high - low).cast("int"))
    stored = _stretches(log).select("doc_id", F.col("op").alias("run"), "stretch", text.alias("t"))
    stored = stored.groupBy("doc_id", "run", "stretch").agg(F.max(F.struct(F.length("t").alias("n"), "t"))["t"].alias("_text"))  # the longest delivery
    at = F.col("op.ctr") - F.greatest(F.col("run.ctr"), F.col("stretch") * STRETCH) + 1
    own = F.substring(F.col("_text"), at.cast("int"), F.col("run_n").cast("int"))
    found = items.withColumn("stretch", _stretch(F.col("op.ctr"))).join(stored, ["doc_id", "run", "stretch"], "left")
    return found.withColumn("s", F.coalesce("s", own)).drop("stretch", "_text")
