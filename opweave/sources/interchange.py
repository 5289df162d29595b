"""Changes as JSON text, one object for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ROWS
from .tables import HEAD, id_text

# The names of actions and value types in the JSON form.
_ACTIONS = {0: "makeMap", 1: "set", 2: "makeList", 3: "del", 4: "makeText", 5: "inc", 6: "makeTable", 7: "mark"}
_TYPED = {"int": "int", "uint": "uint", "f64": "float64", "counter": "counter", "timestamp": "timestamp", "bytes": "bytes"}

_SCHEMA = (
    "actor string, hash string, seq bigint, startOp bigint, time bigint, message string, deps array<string>, extra_bytes string, "
    "ops array<struct<action:string,obj:string,key:string,elemId:string,insert:boolean,datatype:string,value:string,name:string,expand:boolean,pred:array<string>>>"
)


def _value(v):
    return F.coalesce(v["i"].cast("string"), v["u"].cast("string"), v["s"], v["d"].cast("string"), v["flag"].cast("string"), F.lower(F.hex(v["b"])))


def to_json(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``json``: each change (a row of :data:`chunks.ROWS`) as an object with its operations.

    Values are written as text with their type in ``datatype`` (``str``, ``bool`` and ``null`` too), so that
    reading gives back the same values; bytes as hex.
    """

    def op(o):
        named = F.coalesce(*[F.when(o["op_action"] == a, F.lit(n)) for a, n in _ACTIONS.items()])
        tag = o["val"]["tag"]
        kind = F.coalesce(*[F.when(tag == t, F.lit(n)) for t, n in _TYPED.items()], tag)
        return F.struct(
            named.alias("action"), id_text(o["obj"]).alias("obj"), o["op_key"].alias("key"), F.when(o["op_key"].isNull(), id_text(o["elem"], HEAD)).alias("elemId"),
            F.when(o["is_insert"], F.lit(True)).alias("insert"), kind.alias("datatype"), _value(o["val"]).alias("value"), o["mark_name"].alias("name"),
            F.when(o["op_action"] == 7, o["expand"]).alias("expand"), F.transform(o["pred"], lambda p: id_text(p)).alias("pred"),
        )

    ops = F.transform(F.array_sort("ops"), op)
    extra = F.when(F.length("extra") > 0, F.lower(F.hex("extra")))
    body = F.struct(
        "actor", "hash", "seq", F.col("start_op").alias("startOp"), F.col("time_ms").alias("time"), "message", "deps", extra.alias("extra_bytes"), ops.alias("ops")
    )
    return rows.select("doc_id", F.to_json(body).alias("json"))


def from_json(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Rows of :data:`chunks.ROWS` from ``doc_id``, ``json``.  ``PERMISSIVE`` gives rows of nulls for broken lines."""
    c = F.from_json("json", _SCHEMA, {"mode": mode})

    def ident(s):
        zero = F.struct(F.lit(0).cast("bigint").alias("ctr"), F.lit("").alias("actor"))
        parts = F.split(s, "@")
        return F.when(s.isin("_root", "_head"), zero).when(s.isNotNull(), F.struct(parts[0].cast("bigint").alias("ctr"), parts[1].alias("actor")))

    def val(o):
        d, v = o["datatype"], o["value"]
        tag = F.coalesce(*[F.when(d == n, F.lit(t)) for t, n in _TYPED.items()], d)
        return F.when(
            d.isNotNull(),
            F.struct(
                tag.alias("tag"), F.when(d.isin("int", "counter", "timestamp"), v.cast("bigint")).alias("i"), F.when(d == "uint", v.cast("decimal(20,0)")).alias("u"),
                F.when(d == "float64", v.cast("double")).alias("d"), F.when(d == "str", v).alias("s"), F.when(d == "bytes", F.unhex(v)).alias("b"), F.when(d == "bool", v.cast("boolean")).alias("flag"),
            ),
        )

    def op(o, i, start, actor):
        action = F.coalesce(*[F.when(o["action"] == n, F.lit(a)) for a, n in _ACTIONS.items()]).cast("tinyint")
        return F.struct(
            F.struct((start + i).alias("ctr"), actor.alias("actor")).alias("op"), ident(o["obj"]).alias("obj"), o["key"].alias("op_key"), ident(o["elemId"]).alias("elem"),
            F.coalesce(o["insert"], F.lit(False)).alias("is_insert"), action.alias("op_action"), val(o).alias("val"), o["name"].alias("mark_name"),
            F.coalesce(o["expand"], F.lit(False)).alias("expand"), F.transform(o["pred"], lambda p: ident(p)).alias("pred"),
        )

    r = lines.select("doc_id", c.alias("c")).select("doc_id", "c.*")
    n = F.size("ops").cast("bigint")
    return r.select(
        "doc_id", "hash", "actor", "seq", F.col("startOp").alias("start_op"), (F.col("startOp") + n - 1).alias("max_op"), n.alias("num_ops"), F.col("time").alias("time_ms"), "message", "deps",
        F.unhex("extra_bytes").alias("extra"), F.transform("ops", lambda o, i: op(o, i.cast("bigint"), F.col("startOp"), F.col("actor"))).alias("ops"),
    ).select(*[f.split(" ")[0] for f in ROWS.split(", ")])


def summary(changes: DataFrame) -> DataFrame:
    """``doc_id``, ``json`` of each change without its operations."""
    body = F.struct("hash", "actor", "seq", F.col("start_op").alias("startOp"), F.col("time_ms").alias("time"), "message", "deps", F.col("num_ops").alias("numOps"))
    return changes.select("doc_id", F.to_json(body).alias("json"))
