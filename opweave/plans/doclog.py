"""Queries over whole operation logs: change graph, state, sequences, texts, differences, merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery, diff, graph, hydrate, merge, richtext, sequence, state
from ..session import cut
from ..sources.tables import id_text, table
from .logs import _CLEAN, _IDENTITY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def changes(spark: SparkSession, d: str) -> DataFrame:
    return delivery.keep_first(table(spark, d, "changes"))


def ops(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ops")


def middle_version(c: DataFrame) -> DataFrame:
    """A version in the middle of each document's history: the last change of the earlier half of counters."""
    half = c.groupBy("doc_id").agg((F.min("start_op") + F.max("start_op")).alias("_two"))
    early = c.join(half, "doc_id").where(F.col("start_op") * 2 <= F.col("_two"))
    return early.groupBy("doc_id").agg(F.max_by("hash", F.struct("start_op", "hash")).alias("hash"))


def replica_then(c: DataFrame) -> DataFrame:
    """The changes of a replica that stopped at the middle version: its heads and their ancestors."""
    return c.join(graph.ancestors(c, middle_version(c)), graph.KEY, "left_semi")


def state_now(spark: SparkSession, d: str) -> DataFrame:
    return state.visible_ops(ops(spark, d))


def state_then(spark: SparkSession, d: str) -> DataFrame:
    c = changes(spark, d)
    return state.visible_ops(ops(spark, d), graph.clock(c, middle_version(c)))


def typed(df: DataFrame) -> DataFrame:
    """With doubles in the column ``real`` instead of as text in ``value``."""
    is_real = F.coalesce(F.col("kind") == "f64", F.lit(False))
    return df.withColumn("real", F.when(is_real, F.col("value").cast("double"))).withColumn("value", F.when(~is_real, F.col("value")))


# SQL shared by the queries' counterparts
_ID = "CASE WHEN {0}.ctr = 0 THEN '{1}' ELSE {0}.ctr || '@' || {0}.actor END"
_OBJ, _OPID = _ID.format("obj", "_root"), _ID.format("op", "_root")
_HIST = f"""WITH RECURSIVE {_IDENTITY},
c AS (SELECT doc_id, full_hash AS hash, actor, seq, start_op, max_op, num_ops, time_ms, delivery_id FROM kept WHERE copy_no = 1),
d AS (SELECT DISTINCT doc_id, hash, dep FROM (
  SELECT doc_id, full_hash AS hash, {_CLEAN.format('x')} AS dep FROM (SELECT doc_id, full_hash, unnest(deps) AS x FROM kept WHERE copy_no = 1)) WHERE dep IS NOT NULL),
v AS (SELECT doc_id, hash FROM c JOIN (SELECT doc_id, min(start_op) + max(start_op) AS two FROM c GROUP BY ALL) USING (doc_id)
      WHERE start_op * 2 <= two QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start_op DESC, hash DESC) = 1),
anc AS (SELECT doc_id, hash FROM v UNION SELECT d.doc_id, d.dep FROM anc JOIN d USING (doc_id, hash) JOIN c ON (c.doc_id, c.hash) = (d.doc_id, d.dep)),
clk AS (SELECT doc_id, actor, max(max_op) AS max_op, max(seq) AS max_seq FROM c JOIN anc USING (doc_id, hash) GROUP BY ALL)"""
_VIS = """{p}o AS (SELECT DISTINCT doc_id, op, obj, op_key, elem, is_insert, op_action, val, mark_name, pred FROM ops {cover}),
{p}s AS (SELECT doc_id, op, op_action, val.i AS inc, unnest(pred) AS target FROM {p}o),
{p}inc AS (SELECT doc_id, target, sum(inc) AS inc FROM {p}s WHERE op_action = 5 GROUP BY ALL),
{p}vis AS (SELECT o.doc_id, obj, coalesce(op_key, CASE WHEN is_insert THEN op.ctr || '@' || op.actor WHEN elem.ctr = 0 THEN '_head' ELSE elem.ctr || '@' || elem.actor END) AS reg,
  op, CASE WHEN op_key IS NULL THEN CASE WHEN is_insert THEN op ELSE elem END END AS elem, op_action, val,
  CASE WHEN val.tag = 'counter' THEN (val.i + coalesce(inc, 0))::BIGINT END AS n
  FROM {p}o AS o LEFT JOIN {p}inc AS i ON i.doc_id = o.doc_id AND i.target = o.op
  WHERE op_action NOT IN (3, 5, 7) AND NOT EXISTS (SELECT 1 FROM {p}s AS s WHERE s.doc_id = o.doc_id AND s.target = o.op AND s.op <> o.op
    AND NOT (s.op_action = 5 AND coalesce(o.val.tag, '') = 'counter'))),
{p}win AS (SELECT *, count(*) OVER (PARTITION BY doc_id, obj, reg) AS n_values FROM {p}vis
  QUALIFY row_number() OVER (PARTITION BY doc_id, obj, reg ORDER BY op DESC) = 1)"""
_NOW = _VIS.format(p="", cover="")
_COVER = "WHERE EXISTS (SELECT 1 FROM clk WHERE clk.doc_id = ops.doc_id AND clk.actor = ops.op.actor AND ops.op.ctr <= clk.max_op)"
_THEN = _VIS.format(p="b", cover=_COVER)
_KIND = "CASE op_action WHEN 0 THEN 'map' WHEN 2 THEN 'list' WHEN 4 THEN 'text' WHEN 6 THEN 'table' ELSE val.tag END"
_VALUE = """CASE op_action WHEN 0 THEN 'map' WHEN 2 THEN 'list' WHEN 4 THEN 'text' WHEN 6 THEN 'table' ELSE
  coalesce(n::VARCHAR, val.i::VARCHAR, val.u::VARCHAR, val.s, val.flag::VARCHAR, lower(hex(val.b))) END"""
_ROW = f"SELECT doc_id, {_OBJ} AS obj_id, reg, {_OPID} AS op_id, {_KIND} AS kind, {_VALUE} AS value, val.d AS real"
_SEQ = """ins AS (SELECT DISTINCT doc_id, obj, op, elem FROM ops WHERE is_insert AND elem IS NOT NULL),
tree AS (SELECT doc_id, obj, op, [{'c': -op.ctr, 'a': translate(op.actor, '0123456789abcdef', 'fedcba9876543210')}] AS path FROM ins WHERE elem.ctr = 0
  UNION ALL SELECT i.doc_id, i.obj, i.op, list_append(t.path, {'c': -i.op.ctr, 'a': translate(i.op.actor, '0123456789abcdef', 'fedcba9876543210')})
  FROM tree AS t JOIN ins AS i ON i.doc_id = t.doc_id AND i.obj = t.obj AND i.elem = t.op),
pos AS (SELECT doc_id, obj, op AS elem, row_number() OVER (PARTITION BY doc_id, obj ORDER BY path) AS pos FROM tree)"""
_ELEM = "elem.ctr || '@' || elem.actor"


# ---- change graph


@query(f"{_HIST} SELECT doc_id, hash FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = c.doc_id AND d.dep = c.hash)")
def graph_heads(spark, d):
    return graph.heads(changes(spark, d))


@query(f"{_HIST} SELECT doc_id, hash FROM anc")
def graph_ancestors(spark, d):
    c = changes(spark, d)
    return graph.ancestors(c, middle_version(c))


@query(f"{_HIST} SELECT * FROM clk")
def graph_clock_at(spark, d):
    c = changes(spark, d)
    return graph.clock(c, middle_version(c))


@query(f"{_HIST} SELECT doc_id, hash, actor, seq FROM c WHERE NOT EXISTS (SELECT 1 FROM anc WHERE (anc.doc_id, anc.hash) = (c.doc_id, c.hash))")
def graph_changes_since(spark, d):
    c = changes(spark, d)
    return graph.changes_since(c, middle_version(c)).select("doc_id", "hash", "actor", "seq")


@query(f"{_HIST} SELECT doc_id, hash FROM c WHERE NOT EXISTS (SELECT 1 FROM anc WHERE (anc.doc_id, anc.hash) = (c.doc_id, c.hash))")
def graph_changes_added(spark, d):
    """Of a replica that stopped at the middle version and the whole history, what the whole one has and the stopped one hasn't."""
    c = cut(changes(spark, d).select("doc_id", "hash", "start_op", "deps"))
    return graph.changes_added(replica_then(c), c).select("doc_id", "hash")


@query(f"{_HIST} SELECT DISTINCT doc_id, dep AS hash FROM d WHERE NOT EXISTS (SELECT 1 FROM c WHERE (c.doc_id, c.hash) = (d.doc_id, d.dep))")
def graph_missing_deps(spark, d):
    return graph.missing_deps(changes(spark, d))


@query(f"""{_HIST},
link AS (SELECT doc_id, hash, dep FROM d WHERE EXISTS (SELECT 1 FROM c WHERE (c.doc_id, c.hash) = (d.doc_id, d.dep))),
up AS (SELECT doc_id, hash, dep FROM link UNION SELECT up.doc_id, up.hash, link.dep FROM up JOIN link ON (link.doc_id, link.hash) = (up.doc_id, up.dep)),
bad AS (SELECT doc_id, hash FROM d EXCEPT SELECT doc_id, hash FROM link UNION
        (SELECT doc_id, hash FROM d WHERE NOT EXISTS (SELECT 1 FROM c WHERE (c.doc_id, c.hash) = (d.doc_id, d.dep))) UNION (SELECT doc_id, hash FROM up WHERE hash = dep)),
waits AS (SELECT doc_id, hash FROM bad UNION SELECT up.doc_id, up.hash FROM up JOIN bad ON (bad.doc_id, bad.hash) = (up.doc_id, up.dep))
SELECT doc_id, hash, NOT EXISTS (SELECT 1 FROM waits AS w WHERE (w.doc_id, w.hash) = (c.doc_id, c.hash)) AS ready FROM c""")  # fmt: skip
def graph_ready(spark, d):
    return graph.ready(changes(spark, d))


@query(f"{_HIST} SELECT DISTINCT o.doc_id, o.op.ctr AS ctr, o.op.actor AS actor, hash FROM ops AS o JOIN c ON c.doc_id = o.doc_id AND c.actor = o.op.actor AND o.op.ctr BETWEEN start_op AND max_op")
def graph_op_changes(spark, d):
    return graph.op_changes(ops(spark, d), changes(spark, d))


@query(f"{_HIST} SELECT doc_id, actor, seq, count(DISTINCT hash) AS n_hashes FROM c GROUP BY ALL HAVING count(DISTINCT hash) > 1")
def graph_duplicate_seqs(spark, d):
    return graph.duplicate_seqs(changes(spark, d))


@query(f"{_HIST} SELECT doc_id, actor, max(seq) - count(DISTINCT seq) AS n_missing FROM c GROUP BY ALL HAVING max(seq) > count(DISTINCT seq)")
def graph_seq_gaps(spark, d):
    return graph.seq_gaps(changes(spark, d))


@query(f"{_HIST} SELECT doc_id, actor, hash, seq FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, actor ORDER BY seq DESC, hash DESC) = 1")
def graph_last_changes(spark, d):
    return graph.last_changes(changes(spark, d))


@query(f"""{_HIST}, n AS (SELECT doc_id, count(*) AS n_ops FROM (SELECT DISTINCT doc_id, op FROM ops WHERE op_action <> 3) GROUP BY ALL)
SELECT doc_id, count(*) AS n_changes, count(DISTINCT actor) AS n_actors, coalesce(any_value(n_ops), 0) AS n_ops FROM c LEFT JOIN n USING (doc_id) GROUP BY doc_id""")
def graph_stats(spark, d):
    return graph.stats(changes(spark, d), ops(spark, d))


@query(f"""{_HIST} SELECT doc_id, count(*) AS n_ops FROM (
  SELECT DISTINCT ops.doc_id, op FROM ops JOIN anc ON (anc.doc_id, anc.hash) = (ops.doc_id, ops.change_hash)) GROUP BY ALL""")
def graph_fork_at(spark, d):
    c = changes(spark, d)
    _, o = graph.fork(c, ops(spark, d), middle_version(c), strict=False)
    return o.select("doc_id", "op").distinct().groupBy("doc_id").agg(F.count("op").alias("n_ops"))


@query(f"""{_HIST}, h AS (SELECT doc_id, dep AS hash FROM d UNION SELECT doc_id, hash FROM v)
SELECT doc_id, bool_and(EXISTS (SELECT 1 FROM c WHERE (c.doc_id, c.hash) = (h.doc_id, h.hash))) AS has_heads FROM h GROUP BY ALL""")
def graph_contains_version(spark, d):
    c = changes(spark, d)
    wanted = graph.edges(c).select("doc_id", F.col("dep").alias("hash")).unionByName(middle_version(c)).distinct()
    return graph.contains_version(c, wanted)


@query()
def graph_merge_commits(spark, d):
    return graph.merge_commit(changes(spark, d), "00" * 16).select("doc_id", "hash", "seq", "start_op", F.size("deps").alias("n_deps"))


# ---- registers


@query(f"WITH {_NOW} {_ROW}, n_values > 1 AS conflict FROM win")
def state_get(spark, d):
    return typed(state.get(state_now(spark, d)))


@query(f"{_HIST}, {_THEN} {_ROW}, n_values > 1 AS conflict FROM bwin")
def state_get_at(spark, d):
    return typed(state.get(state_then(spark, d)))


@query(f"WITH {_NOW} {_ROW} FROM vis")
def state_get_all(spark, d):
    return typed(state.get_all(state_now(spark, d)))


@query(f"{_HIST}, {_THEN} {_ROW} FROM bvis QUALIFY count(*) OVER (PARTITION BY doc_id, obj, reg) > 1")
def state_conflicts_at(spark, d):
    return typed(state.conflicts(state_then(spark, d)))


@query(f"WITH {_NOW} {_ROW} FROM vis QUALIFY count(*) OVER (PARTITION BY doc_id, obj, reg) > 1")
def state_conflicts(spark, d):
    return typed(state.conflicts(state_now(spark, d)))


@query(f"WITH {_NOW} SELECT doc_id, {_OBJ} AS obj_id, reg, {_OPID} AS op_id, n FROM vis WHERE n IS NOT NULL")
def state_counters(spark, d):
    return state.counters(state_now(spark, d))


@query(f"{_HIST}, {_THEN} SELECT doc_id, {_OBJ} AS obj_id, reg, {_OPID} AS op_id, n FROM bvis WHERE n IS NOT NULL")
def state_counters_at(spark, d):
    return state.counters(state_then(spark, d))


@query(f"WITH {_NOW} SELECT doc_id, {_OBJ} AS obj_id, reg AS op_key FROM win WHERE elem IS NULL")
def state_keys(spark, d):
    return state.keys(state_now(spark, d))


@query(f"WITH {_NOW} {_ROW}, n_values > 1 AS conflict FROM win WHERE elem IS NULL AND reg >= 'c' AND reg < 't'")
def state_map_range(spark, d):
    return typed(state.map_range(state_now(spark, d), "c", "t"))


@query(f"WITH {_NOW} SELECT doc_id, {_OBJ} AS obj_id, count(*) AS length FROM win GROUP BY doc_id, obj")
def state_lengths(spark, d):
    return state.lengths(state_now(spark, d))


@query(f"""SELECT DISTINCT doc_id, {_OPID} AS obj_id, CASE op_action WHEN 0 THEN 'map' WHEN 2 THEN 'list' WHEN 4 THEN 'text' ELSE 'table' END AS obj_type, {_OBJ} AS parent_id,
  coalesce(op_key, CASE WHEN is_insert THEN op.ctr || '@' || op.actor ELSE {_ELEM} END) AS reg FROM ops WHERE op_action IN (0, 2, 4, 6)""")
def state_objects(spark, d):
    return state.objects(ops(spark, d))


@query("""SELECT doc_id, CASE op_action WHEN 0 THEN 'map' WHEN 2 THEN 'list' WHEN 4 THEN 'text' ELSE 'table' END AS obj_type, count(*) AS n_objects
FROM (SELECT DISTINCT doc_id, op, op_action FROM ops WHERE op_action IN (0, 2, 4, 6)) GROUP BY ALL""")
def state_object_kinds(spark, d):
    return state.object_kinds(state.objects(ops(spark, d)))


@query(f"""WITH {_NOW}, m AS (SELECT o.*, x.op_action AS made FROM o LEFT JOIN (SELECT DISTINCT doc_id, op, op_action FROM ops) AS x ON x.doc_id = o.doc_id AND x.op = o.obj),
e AS (SELECT doc_id, op, CASE WHEN op_action = 5 AND val.i IS NULL THEN 'InvalidOpType' WHEN obj.ctr <> 0 AND made IS NULL THEN 'InvalidObjId'
  WHEN obj.ctr <> 0 AND made NOT IN (0, 2, 4, 6) THEN 'NotAnObject' WHEN (obj.ctr = 0 OR made NOT IN (2, 4)) AND op_key IS NULL THEN 'InvalidOp'
  WHEN obj.ctr <> 0 AND made IN (2, 4) AND op_key IS NOT NULL THEN 'InvalidOp' END AS error FROM m)
SELECT doc_id, {_OPID} AS op_id, error FROM e WHERE error IS NOT NULL UNION ALL
SELECT doc_id, {_OPID}, 'MissingCounter' FROM o WHERE op_action = 5 AND NOT EXISTS (
  SELECT 1 FROM s JOIN o AS t ON t.doc_id = s.doc_id AND t.op = s.target WHERE s.doc_id = o.doc_id AND s.op = o.op AND t.val.tag = 'counter')""")
def state_invalid_ops(spark, d):
    return state.invalid_ops(ops(spark, d))


@query(f"""WITH RECURSIVE {_NOW},
ob AS (SELECT DISTINCT doc_id, op, obj, coalesce(op_key, CASE WHEN is_insert THEN op.ctr || '@' || op.actor ELSE {_ELEM} END) AS reg FROM ops WHERE op_action IN (0, 2, 4, 6)),
pa AS (SELECT doc_id, op, reg AS path, 1 AS depth, EXISTS (SELECT 1 FROM win WHERE win.doc_id = ob.doc_id AND win.op = ob.op) AS visible FROM ob WHERE obj.ctr = 0
  UNION ALL SELECT ob.doc_id, ob.op, pa.path || '/' || ob.reg, depth + 1, visible AND EXISTS (SELECT 1 FROM win WHERE win.doc_id = ob.doc_id AND win.op = ob.op)
  FROM pa JOIN ob ON ob.doc_id = pa.doc_id AND ob.obj = pa.op)
SELECT doc_id, {_OPID} AS obj_id, path, depth::BIGINT AS depth, visible FROM pa""")
def state_paths(spark, d):
    return state.paths(ops(spark, d), state_now(spark, d))


@query(f"""WITH RECURSIVE {_NOW}, {_SEQ},
x AS (SELECT win.*, pos FROM win LEFT JOIN pos ON (pos.doc_id, pos.obj, pos.elem) = (win.doc_id, win.obj, win.elem) WHERE win.elem IS NULL OR pos IS NOT NULL)
SELECT doc_id, {_OBJ} AS obj_id, row_number() OVER (PARTITION BY doc_id, obj ORDER BY pos NULLS FIRST, reg) - 1 AS item_no, reg, {_KIND} AS kind, {_VALUE} AS value, val.d AS real FROM x""")
def state_iterate(spark, d):
    return typed(state.iterate(state_now(spark, d), sequence.element_order(ops(spark, d))))


# ---- sequences


@query(f"WITH RECURSIVE {_SEQ} SELECT doc_id, {_OBJ} AS obj_id, {_ELEM} AS elem_id, pos FROM pos")
def seq_order(spark, d):
    return sequence.element_order(ops(spark, d)).select("doc_id", id_text("obj").alias("obj_id"), id_text("elem").alias("elem_id"), "pos")


@query(f"""WITH RECURSIVE {_NOW}, {_SEQ},
l AS (SELECT win.*, row_number() OVER (PARTITION BY win.doc_id, win.obj ORDER BY pos) - 1 AS idx FROM win JOIN pos ON (pos.doc_id, pos.obj, pos.elem) = (win.doc_id, win.obj, win.elem))
{_ROW}, idx FROM l WHERE idx BETWEEN 1 AND 7""")
def seq_list_range(spark, d):
    rows = sequence.list_range(state.winners(state_now(spark, d)), sequence.element_order(ops(spark, d)), 1, 8)
    return typed(rows.select("doc_id", id_text("obj").alias("obj_id"), "reg", id_text("op").alias("op_id"), state._kind(), state._value(), "idx"))


_CURSORS = f"""WITH RECURSIVE {_NOW}, {_SEQ},
cur AS (SELECT pos.doc_id, pos.obj, pos.elem, pos, win.op IS NOT NULL AS visible,
  coalesce(sum((win.op IS NOT NULL)::INT) OVER (PARTITION BY pos.doc_id, pos.obj ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS idx
  FROM pos LEFT JOIN win ON (pos.doc_id, pos.obj, pos.elem) = (win.doc_id, win.obj, win.elem))"""


@query(f"{_CURSORS} SELECT doc_id, {_OBJ} AS obj_id, {_ELEM} AS elem_id, idx, visible FROM cur")
def seq_cursors(spark, d):
    rows = sequence.cursor_positions(state.winners(state_now(spark, d)), sequence.element_order(ops(spark, d)))
    return rows.select("doc_id", id_text("obj").alias("obj_id"), id_text("elem").alias("elem_id"), "idx", "visible")


@query(f"""{_CURSORS},
back AS (SELECT doc_id, obj, elem AS start, elem AS at FROM cur UNION ALL
  SELECT b.doc_id, b.obj, b.start, ins.elem FROM back AS b JOIN cur ON (cur.doc_id, cur.obj, cur.elem) = (b.doc_id, b.obj, b.at) AND NOT cur.visible
  JOIN ins ON (ins.doc_id, ins.obj, ins.op) = (b.doc_id, b.obj, b.at) WHERE ins.elem.ctr > 0)
SELECT b.doc_id, CASE WHEN b.obj.ctr = 0 THEN '_root' ELSE b.obj.ctr || '@' || b.obj.actor END AS obj_id, b.start.ctr || '@' || b.start.actor AS elem_id,
  coalesce(max(cur.idx) FILTER (cur.visible), 0) AS idx FROM back AS b LEFT JOIN cur ON (cur.doc_id, cur.obj, cur.elem) = (b.doc_id, b.obj, b.at) GROUP BY b.doc_id, b.obj, b.start""")  # fmt: skip
def seq_cursors_before(spark, d):
    at = sequence.cursor_positions(state.winners(state_now(spark, d)), sequence.element_order(ops(spark, d)))
    rows = sequence.cursor_positions_before(at, ops(spark, d))
    return rows.select("doc_id", id_text("obj").alias("obj_id"), id_text("elem").alias("elem_id"), "idx")


# ---- texts


def _text_parts(spark, d, encoding="codepoints"):
    order = sequence.element_order(ops(spark, d))
    return richtext.text_items(ops(spark, d), state_now(spark, d), order, encoding), order


_ITEMS = f"""WITH RECURSIVE {_NOW}, {_SEQ},
it AS (SELECT vis.doc_id, vis.obj, vis.elem, pos.pos, vis.op, CASE WHEN val.tag = 'str' THEN val.s ELSE chr(65532) END AS s FROM vis
  JOIN pos ON (pos.doc_id, pos.obj, pos.elem) = (vis.doc_id, vis.obj, vis.elem) JOIN (SELECT DISTINCT doc_id, op FROM ops WHERE op_action = 4) AS t ON t.doc_id = vis.doc_id AND t.op = vis.obj),
item AS (SELECT *, length(s) AS width, coalesce(sum(length(s)) OVER (PARTITION BY doc_id, obj ORDER BY pos, op ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM it)"""
_MARKED = f"""{_ITEMS},
mk AS (SELECT o.doc_id, o.obj, o.op, mark_name AS name, val, pos.pos FROM o JOIN pos ON (pos.doc_id, pos.obj, pos.elem) = (o.doc_id, o.obj, o.op) WHERE op_action = 7),
iv AS (SELECT b.doc_id, b.obj, b.op, b.name, coalesce(b.val.i::VARCHAR, b.val.s, b.val.flag::VARCHAR) AS value, b.pos AS p1, coalesce(e.pos, 1::BIGINT << 61) AS p2
  FROM mk AS b LEFT JOIN mk AS e ON e.name IS NULL AND e.doc_id = b.doc_id AND e.obj = b.obj AND e.op.actor = b.op.actor AND e.op.ctr = b.op.ctr + 1 WHERE b.name IS NOT NULL),
im AS (SELECT item.*, iv.name, iv.value FROM item JOIN iv ON iv.doc_id = item.doc_id AND iv.obj = item.obj AND item.pos > p1 AND item.pos < p2
  QUALIFY row_number() OVER (PARTITION BY item.doc_id, item.obj, item.pos, item.op, iv.name ORDER BY iv.op DESC) = 1),
ok AS (SELECT * FROM im WHERE value IS NOT NULL)"""


@query(f"{_ITEMS} SELECT doc_id, {_OBJ} AS obj_id, string_agg(s, '' ORDER BY pos, op) AS text, sum(width)::BIGINT AS length FROM item GROUP BY doc_id, obj")
def text_content(spark, d):
    return richtext.texts(_text_parts(spark, d)[0])


@query(f"{_ITEMS} SELECT doc_id, {_OBJ} AS obj_id, sum(strlen(s))::BIGINT AS length FROM item GROUP BY doc_id, obj")
def text_length_utf8(spark, d):
    return richtext.texts(_text_parts(spark, d, "utf8")[0]).select("doc_id", "obj_id", "length")


@query(f"{_ITEMS} SELECT doc_id, {_OBJ} AS obj_id, sum(length(s) + length(regexp_replace(s, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')))::BIGINT AS length FROM item GROUP BY doc_id, obj")
def text_length_utf16(spark, d):
    return richtext.texts(_text_parts(spark, d, "utf16")[0]).select("doc_id", "obj_id", "length")


@query(f"""{_MARKED},
r AS (SELECT *, sum(CASE WHEN prev_end = start AND prev_value IS NOT DISTINCT FROM value THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, obj, name ORDER BY start, pos, op) AS run FROM (
  SELECT *, lag(start + width) OVER w AS prev_end, lag(value) OVER w AS prev_value FROM ok WINDOW w AS (PARTITION BY doc_id, obj, name ORDER BY start, pos, op)))
SELECT doc_id, {_OBJ} AS obj_id, name, value, min(start)::BIGINT AS start, max(start + width)::BIGINT AS "end" FROM r GROUP BY doc_id, obj, name, value, run""")
def text_marks(spark, d):
    items, order = _text_parts(spark, d)
    return richtext.marks(items, richtext.mark_intervals(ops(spark, d), order))


@query(f"""{_MARKED},
m AS (SELECT item.doc_id, item.obj, item.pos, item.op, item.s, coalesce(string_agg(ok.name || '=' || ok.value, ',' ORDER BY ok.name || '=' || ok.value), '') AS marks
  FROM item LEFT JOIN ok ON (ok.doc_id, ok.obj, ok.pos, ok.op) = (item.doc_id, item.obj, item.pos, item.op) GROUP BY ALL),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, obj ORDER BY pos, op) AS span_no FROM (
  SELECT *, CASE WHEN lag(marks) OVER (PARTITION BY doc_id, obj ORDER BY pos, op) = marks THEN 0 ELSE 1 END AS fresh FROM m))
SELECT doc_id, {_OBJ} AS obj_id, span_no::BIGINT AS span_no, string_agg(s, '' ORDER BY pos, op) AS text, marks, NULL::VARCHAR AS block_id FROM n GROUP BY doc_id, obj, span_no, marks""")
def text_spans(spark, d):
    items, order = _text_parts(spark, d)
    return richtext.spans(items, richtext.mark_intervals(ops(spark, d), order))


# ---- differences and merges


@query(f"""{_HIST}, {_NOW}, {_THEN},
j AS (SELECT coalesce(win.doc_id, b.doc_id) AS doc_id, coalesce(win.obj, b.obj) AS obj, coalesce(win.reg, b.reg) AS reg, win.op, b.op AS old_op, win.op_action, win.val, win.n, b.n AS old_n,
  win.n_values > 1 AS conflict, b.n_values > 1 AS old_conflict FROM win FULL JOIN bwin AS b ON (b.doc_id, b.obj, b.reg) = (win.doc_id, win.obj, win.reg)),
a AS (SELECT *, CASE WHEN op IS NULL THEN 'delete' WHEN old_op IS NULL OR op <> old_op THEN 'put' WHEN n <> old_n THEN 'increment' WHEN conflict <> old_conflict THEN 'conflict' END AS action FROM j)
SELECT doc_id, {_OBJ} AS obj_id, reg, action, CASE WHEN action IN ('put', 'increment') THEN {_VALUE} END AS value, CASE WHEN action = 'put' THEN {_KIND} END AS kind, CASE WHEN action = 'put' THEN val.d END AS real,
  CASE WHEN op IS NOT NULL THEN {_OPID} END AS op_id, CASE WHEN action = 'increment' THEN n - old_n END AS delta, conflict FROM a WHERE action IS NOT NULL""")  # fmt: skip
def diff_registers(spark, d):
    return typed(diff.register_diff(state_then(spark, d), state_now(spark, d)))


@query(f"""{_HIST}, {_NOW}, {_THEN}, {_SEQ},
j AS (SELECT pos.doc_id, pos.obj, pos.pos, win.op, b.op AS old_op, win.op_action, win.val, win.n, b.n AS old_n FROM pos
  LEFT JOIN win ON (win.doc_id, win.obj, win.elem) = (pos.doc_id, pos.obj, pos.elem) LEFT JOIN bwin AS b ON (b.doc_id, b.obj, b.elem) = (pos.doc_id, pos.obj, pos.elem)
  WHERE win.op IS NOT NULL OR b.op IS NOT NULL),
a AS (SELECT *, coalesce(sum((op IS NOT NULL)::INT) OVER (PARTITION BY doc_id, obj ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS idx,
  CASE WHEN op IS NULL THEN 'delete' WHEN old_op IS NULL THEN 'insert' WHEN op <> old_op OR n IS DISTINCT FROM old_n THEN 'put' END AS action FROM j)
SELECT doc_id, {_OBJ} AS obj_id, row_number() OVER (PARTITION BY doc_id, obj ORDER BY pos) AS patch_no, action, idx, CASE WHEN op IS NOT NULL THEN {_VALUE} END AS value, CASE WHEN op IS NOT NULL THEN val.d END AS real
FROM a WHERE action IS NOT NULL""")  # fmt: skip
def diff_lists(spark, d):
    rows = diff.list_diff(state_then(spark, d), state_now(spark, d), sequence.element_order(ops(spark, d)))
    return typed(rows).drop("kind")


@query(f"WITH {_NOW} SELECT doc_id, {_OBJ} AS obj_id, reg, {_KIND} AS kind, {_VALUE} AS value, val.d AS real, n_values > 1 AS conflict FROM win")
def diff_apply(spark, d):
    """The middle version with the patches to the current one applied: the current state."""
    then, now = state_then(spark, d), state_now(spark, d)
    return typed(diff.apply_patches(state.get(then), diff.register_diff(then, now)))


@query()
def diff_patch_runs(spark, d):
    rows = diff.list_diff(state_then(spark, d), state_now(spark, d), sequence.element_order(ops(spark, d)))
    return diff.coalesce_patches(rows).select("doc_id", "obj_id", "first_no", "action", "idx", "n")


@query()
def diff_texts(spark, d):
    """The splices that lead from the middle version of every text to the current one."""
    o = ops(spark, d)
    texts = richtext.text_objects(o).select("doc_id", id_text("obj").alias("obj_id"))
    rows = diff.list_diff(state_then(spark, d), state_now(spark, d), sequence.element_order(o)).join(texts, ["doc_id", "obj_id"], "left_semi")
    return diff.coalesce_patches(rows).select("doc_id", "obj_id", "first_no", "action", "idx", "n", F.array_join("values", "").alias("text"))


@query(f"{_HIST} SELECT doc_id, hash, actor, seq, start_op, max_op FROM c")
def merge_histories(spark, d):
    """Two replicas merged: one that stopped at the middle version, one with all changes."""
    c = cut(changes(spark, d).select("doc_id", "hash", "actor", "seq", "start_op", "max_op", "deps"))
    return merge.merge_changes(replica_then(c).drop("deps"), c.drop("deps"))


@query("SELECT DISTINCT doc_id, op.ctr AS ctr, op.actor AS actor, op_action::INT AS op_action FROM ops")
def merge_logs(spark, d):
    """Two replicas, one that stopped after two thirds of the deliveries and one that joined after a third: together they hold every row."""
    o = ops(spark, d).select("delivery_id", "doc_id", "op", F.col("op_action").cast("int").alias("op_action"))
    last = o.agg(F.max("delivery_id")).scalar()
    early, late = (F.coalesce(x, F.lit(True)) for x in (F.col("delivery_id") * 3 <= last * 2, F.col("delivery_id") * 3 >= last))
    return merge.merge_ops(*(o.where(x).drop("delivery_id") for x in (early, late))).select("doc_id", "op.ctr", "op.actor", "op_action")


@query(f"""{_HIST}, {_NOW}, {_THEN},
x AS (SELECT doc_id, obj, reg, {_VALUE} AS value, val.d AS real, n_values > 1 AS conflict FROM win), y AS (SELECT doc_id, obj, reg, {_VALUE} AS value, val.d AS real, n_values > 1 AS conflict FROM bwin),
odd AS ((SELECT * FROM x EXCEPT SELECT * FROM y) UNION (SELECT * FROM y EXCEPT SELECT * FROM x))
SELECT doc_id, NOT EXISTS (SELECT 1 FROM odd WHERE odd.doc_id = v.doc_id) AS same FROM (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM vis UNION SELECT doc_id FROM bvis)) AS v""")
def merge_same_documents(spark, d):
    return merge.same_documents(state_then(spark, d), state_now(spark, d))


@query()
def hydrate_json(spark, d):
    items, order = _text_parts(spark, d)
    return hydrate.documents_json(state_now(spark, d), order, richtext.texts(items))
