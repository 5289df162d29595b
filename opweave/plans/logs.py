"""Queries p1 to p3 and p5 to p7 over the delivered log tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery, feed, hierarchy, orphans, sessions, skew
from ..sources.tables import clean_changes, clean_id, id_text, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    actors = table(spark, d, "changes").select(clean_id("actor").alias("key_value"), "doc_id")
    objs = table(spark, d, "ops").select("doc_id", F.col("obj.ctr").alias("ctr"), F.col("obj.actor").alias("actor"), "op_action")
    by_actor = skew.heavy_keys(actors, ["key_value"], "doc_id").select(F.lit("changes.actor").alias("field_name"), "key_value")
    by_obj = skew.heavy_keys(objs, ["doc_id", "ctr", "actor"], "op_action").select(
        F.lit("ops.obj").alias("field_name"),
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), id_text(F.struct("ctr", "actor"))).alias("key_value"),
    )
    return by_actor.unionByName(by_obj)


def p1_actor_profile(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "changes").select(clean_id("actor").alias("actor"), "doc_id", "num_ops")
    out = skew.key_profile(c, ["actor"], "doc_id")
    pct = skew.key_percentiles(c, ["actor"], "num_ops", [0.5, 0.9])
    return out.join(pct, "actor", "left").select("actor", "n_rows", "n_distinct", "mode_value", "mode_rows", "p50", "p90")


def p1_object_profile(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "ops").select("doc_id", F.col("obj.ctr").alias("obj_ctr"), F.col("obj.actor").alias("obj_actor"), F.col("op_action").cast("int").alias("op_action"))
    return skew.key_profile(o, ["doc_id", "obj_ctr", "obj_actor"], "op_action")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.further_copies(table(spark, d, "changes"))


def p2_distinct_changes(spark: SparkSession, d: str) -> DataFrame:
    return delivery.keep_first(table(spark, d, "changes")).select(
        "delivery_id", "doc_id", "hash", "actor", "seq", "start_op", "max_op", "num_ops", "time_ms"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return feed.current_entries(table(spark, d, "ops"))


def p3_entries_with_base(spark: SparkSession, d: str) -> DataFrame:
    return feed.current_entries(table(spark, d, "ops"), table(spark, d, "base_objects"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "changes"), table(spark, d, "ops"), table(spark, d, "archive_hashes"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(table(spark, d, "changes"), table(spark, d, "ops"), table(spark, d, "archive_hashes"))


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    kept = delivery.keep_first(table(spark, d, "changes").select("delivery_id", "doc_id", "hash", "actor", "seq", "time_ms"))
    return sessions.sessions(kept, "actor", "time_ms")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_sessions(spark, d).select("actor", "start_ms", "end_ms")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.on_loops(*(table(spark, d, t) for t in ("changes", "ops", "base_objects")))


def p7_objects(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.object_hierarchy(table(spark, d, "ops"), table(spark, d, "base_objects"))


def p7_changes(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.change_hierarchy(table(spark, d, "changes"))


_CLEAN = r"nullif(lower(trim({0}, E' \t\r\n ')), '')"
_CH = f"ch AS (SELECT delivery_id, doc_id, {_CLEAN.format('hash')} AS hash, {_CLEAN.format('actor')} AS actor, seq, start_op, max_op, num_ops, time_ms, received_at, deps FROM changes)"
#: Each delivery with the identity of its change.
_IDENTITY = f"""{_CH},
owner AS (SELECT doc_id, actor, seq, arg_min(hash, delivery_id) AS owner FROM ch WHERE hash IS NOT NULL GROUP BY ALL),
ident AS (SELECT ch.*, coalesce(ch.hash, owner, ch.doc_id || '|' || ch.actor || '|' || ch.seq, 'alone ' || ch.delivery_id) AS who, coalesce(ch.hash, owner) AS full_hash
          FROM ch LEFT JOIN owner USING (doc_id, actor, seq)),
kept AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY delivery_id) AS copy_no FROM ident)"""
_SESSIONS = f"""WITH {_IDENTITY},
t AS (SELECT actor, time_ms, CASE WHEN time_ms - lag(time_ms) OVER w <= 1800000 THEN 0 ELSE 1 END AS is_new
      FROM kept WHERE copy_no = 1 AND time_ms > 0 AND actor IS NOT NULL WINDOW w AS (PARTITION BY actor ORDER BY time_ms)),
s AS (SELECT *, sum(is_new) OVER (PARTITION BY actor ORDER BY time_ms ROWS UNBOUNDED PRECEDING) AS no FROM t)
SELECT actor, min(time_ms) AS start_ms, max(time_ms) AS end_ms"""
_ENTRIES = """WITH o AS ({rows}),
sup AS (SELECT doc_id, op, op_action, unnest(pred) AS target FROM o),
live AS (SELECT DISTINCT o.doc_id, o.obj, o.op_key, o.op FROM o WHERE o.op_key IS NOT NULL AND o.op_action NOT IN (3, 5)
  AND NOT EXISTS (SELECT 1 FROM sup WHERE sup.doc_id = o.doc_id AND sup.target = o.op AND sup.op <> o.op
                  AND NOT (sup.op_action = 5 AND coalesce(o.tag, '') = 'counter')))
SELECT doc_id, CASE WHEN obj.ctr = 0 THEN '_root' ELSE obj.ctr || '@' || obj.actor END AS obj_id, op_key,
       max(op).ctr || '@' || max(op).actor AS op_id
FROM live GROUP BY doc_id, obj, op_key"""
_OPS_ROWS = "SELECT doc_id, op, obj, op_key, op_action, val.tag AS tag, pred FROM ops"
_PROFILE = """SELECT {keys}, n_rows::BIGINT AS n_rows, n_distinct, mode_value, mode_rows FROM (
  SELECT {keys}, sum(w) AS n_rows, count(v) AS n_distinct FROM f GROUP BY ALL)
  JOIN (SELECT {keys}, v AS mode_value, w AS mode_rows FROM f WHERE v IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY w DESC, v) = 1) USING ({keys})"""

QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_actor_profile, p1_object_profile, p2_found, p2_distinct_changes, p3_found, p3_entries_with_base,
        p5_found, p5_report, p6_found, p6_sessions, p7_found, p7_objects, p7_changes,
    )
}

ORACLES = {
    "p1_found": f"""WITH {_CH},
a AS (SELECT actor, count(*) AS n FROM ch GROUP BY 1),
o AS (SELECT doc_id, obj, count(*) AS n FROM ops GROUP BY ALL)
SELECT 'changes.actor' AS field_name, actor AS key_value FROM a WHERE n * 25 >= (SELECT count(*) FROM ch) AND actor IS NOT NULL
UNION ALL
SELECT 'ops.obj', doc_id || ':' || CASE WHEN obj.ctr = 0 THEN '_root' ELSE obj.ctr || '@' || obj.actor END
FROM o WHERE n * 25 >= (SELECT count(*) FROM ops)""",
    "p1_actor_profile": f"""WITH {_CH}, f AS (SELECT actor, doc_id AS v, count(*) AS w FROM ch GROUP BY ALL),
p AS ({_PROFILE.format(keys='actor')}),
q AS (SELECT actor, quantile_disc(num_ops, 0.5) AS p50, quantile_disc(num_ops, 0.9) AS p90 FROM ch GROUP BY ALL)
SELECT p.*, p50, p90 FROM p JOIN q USING (actor)""",
    "p1_object_profile": f"""WITH f AS (SELECT doc_id, obj.ctr AS obj_ctr, obj.actor AS obj_actor, op_action::INT AS v, count(*) AS w FROM ops GROUP BY ALL)
{_PROFILE.format(keys='doc_id, obj_ctr, obj_actor')}""",
    "p2_found": f"WITH {_IDENTITY} SELECT delivery_id FROM kept WHERE copy_no > 1",
    "p2_distinct_changes": f"""WITH {_IDENTITY} SELECT delivery_id, doc_id, full_hash AS hash, actor, seq, start_op, max_op, num_ops, time_ms
FROM kept WHERE copy_no = 1""",
    "p3_found": _ENTRIES.format(rows=_OPS_ROWS),
    "p3_entries_with_base": _ENTRIES.format(rows=f"{_OPS_ROWS} UNION ALL SELECT doc_id, op, obj, op_key, op_action, NULL, [] FROM base_objects"),
    "p5_found": f"""WITH {_IDENTITY},
r AS (SELECT DISTINCT doc_id, full_hash AS referrer_id, {_CLEAN.format('d')} AS target_id FROM (SELECT doc_id, full_hash, unnest(deps) AS d FROM ident)),
k AS (SELECT doc_id, hash FROM ch UNION SELECT doc_id, {_CLEAN.format('hash')} FROM archive_hashes),
x AS (SELECT DISTINCT doc_id, op, unnest(pred) AS t FROM ops), y AS (SELECT DISTINCT doc_id, op FROM ops)
SELECT 'changes' AS ref_table, doc_id, referrer_id, target_id FROM r
WHERE target_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = r.doc_id AND k.hash = r.target_id)
UNION ALL
SELECT 'ops', doc_id, op.ctr || '@' || op.actor, CASE WHEN t.ctr = 0 THEN '_root' ELSE t.ctr || '@' || t.actor END FROM x
WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.doc_id = x.doc_id AND y.op = x.t)""",
    "p5_report": f"""WITH RECURSIVE {_IDENTITY},
cr AS (SELECT 'changes' AS tbl, doc_id, full_hash AS id, {_CLEAN.format('d')} AS target, delivery_id FROM (SELECT doc_id, full_hash, unnest(deps) AS d, delivery_id FROM ident)),
oref AS (SELECT 'ops' AS tbl, doc_id, op.ctr || '@' || op.actor AS id, t.ctr || '@' || t.actor AS target, delivery_id FROM (SELECT doc_id, op, unnest(pred) AS t, delivery_id FROM ops)),
r AS (SELECT * FROM cr WHERE target IS NOT NULL UNION ALL SELECT * FROM oref),
nodes AS (SELECT 'changes' AS tbl, doc_id, full_hash AS id, min(delivery_id) AS first_id FROM ident WHERE full_hash IS NOT NULL GROUP BY ALL
          UNION ALL SELECT 'ops', doc_id, op.ctr || '@' || op.actor, min(delivery_id) FROM ops GROUP BY ALL),
known AS (SELECT tbl, doc_id, id FROM nodes UNION SELECT 'changes', doc_id, {_CLEAN.format('hash')} FROM archive_hashes),
orphan AS (SELECT tbl, doc_id, id, target, min(delivery_id) AS first_id FROM r WHERE NOT EXISTS (SELECT 1 FROM known AS k WHERE (k.tbl, k.doc_id, k.id) = (r.tbl, r.doc_id, r.target)) GROUP BY ALL),
link AS (SELECT DISTINCT tbl, doc_id, id, target FROM r WHERE id IS NOT NULL),
bad AS (SELECT DISTINCT tbl, doc_id, id FROM orphan WHERE id IS NOT NULL UNION SELECT link.tbl, link.doc_id, link.id FROM link JOIN bad ON (bad.tbl, bad.doc_id, bad.id) = (link.tbl, link.doc_id, link.target)),
direct AS (SELECT tbl, doc_id, id, min(first_id) AS first_id FROM orphan WHERE id IS NOT NULL GROUP BY ALL),
inherited AS (SELECT bad.*, nodes.first_id FROM bad JOIN nodes USING (tbl, doc_id, id) WHERE NOT EXISTS (SELECT 1 FROM direct AS x WHERE (x.tbl, x.doc_id, x.id) = (bad.tbl, bad.doc_id, bad.id))),
counted AS (SELECT tbl, first_id, 1 AS r, 0 AS d, 0 AS i FROM orphan UNION ALL SELECT tbl, first_id, 0, 1, 0 FROM direct UNION ALL SELECT tbl, first_id, 0, 0, 1 FROM inherited)
SELECT tbl AS ref_table, date_trunc('week', received_at)::DATE AS period, sum(r)::BIGINT AS n_references, sum(d)::BIGINT AS n_direct, sum(i)::BIGINT AS n_inherited
FROM counted LEFT JOIN changes ON delivery_id = first_id GROUP BY ALL""",
    "p6_found": f"{_SESSIONS} FROM s GROUP BY actor, no",
    "p6_sessions": f"{_SESSIONS}, max(time_ms) - min(time_ms) AS duration_ms, count(*) AS n_events FROM s GROUP BY actor, no",
    "p7_objects": """WITH RECURSIVE made AS (SELECT doc_id, op, obj FROM ops WHERE op_action IN (0, 2, 4, 6) UNION ALL SELECT doc_id, op, obj FROM base_objects),
n AS (SELECT doc_id, op.ctr || '@' || op.actor AS id, op.ctr AS ctr, min(obj) AS up FROM made GROUP BY doc_id, op),
m AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY ctr, id)::INT AS no, CASE WHEN up.ctr > 0 THEN up.ctr || '@' || up.actor END AS up FROM n),
t AS (SELECT doc_id, id, no, id AS root_id, [no] AS path FROM m WHERE up IS NULL OR NOT EXISTS (SELECT 1 FROM m AS x WHERE (x.doc_id, x.id) = (m.doc_id, m.up))
      UNION ALL SELECT m.doc_id, m.id, m.no, t.root_id, list_append(t.path, m.no) FROM m JOIN t ON (t.doc_id, t.id) = (m.doc_id, m.up)),
b AS (SELECT doc_id, no, count(*) - 1 AS n_descendants FROM (SELECT doc_id, unnest(path) AS no FROM t) GROUP BY ALL)
SELECT doc_id, id AS node_id, no AS node_no, root_id, len(path)::BIGINT AS depth, path, n_descendants, false AS on_loop FROM t JOIN b USING (doc_id, no)
UNION ALL SELECT doc_id, id, NULL, NULL, -1, NULL, NULL, true FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE (t.doc_id, t.id) = (m.doc_id, m.id))""",
    "p7_found": f"""WITH RECURSIVE {_IDENTITY},
e AS (SELECT 'obj' AS k, doc_id, op.ctr || '@' || op.actor AS id, obj.ctr || '@' || obj.actor AS up FROM ops WHERE op_action IN (0, 2, 4, 6)
      UNION SELECT 'obj', doc_id, op.ctr || '@' || op.actor, obj.ctr || '@' || obj.actor FROM base_objects
      UNION SELECT 'change', doc_id, hash, {_CLEAN.format('d')} FROM (SELECT doc_id, full_hash AS hash, unnest(deps) AS d FROM ident WHERE full_hash IS NOT NULL)),
l AS (SELECT e.* FROM e WHERE EXISTS (SELECT 1 FROM e AS x WHERE (x.k, x.doc_id, x.id) = (e.k, e.doc_id, e.up))
      OR (e.k = 'change' AND EXISTS (SELECT 1 FROM ch WHERE (ch.doc_id, ch.hash) = (e.doc_id, e.up)))),
up AS (SELECT k, doc_id, id, up FROM l UNION SELECT up.k, up.doc_id, up.id, l.up FROM up JOIN l ON (l.k, l.doc_id, l.id) = (up.k, up.doc_id, up.up)),
bad AS (SELECT k, doc_id, id FROM up WHERE id = up UNION SELECT up.k, up.doc_id, up.id FROM up JOIN up AS o ON (o.k, o.doc_id, o.id, o.up) = (up.k, up.doc_id, up.up, up.up))
SELECT DISTINCT k AS node_kind, doc_id, id AS node_id FROM bad""",
}
