"""The binary chunk format: documents, changes, compressed changes and bundles as bytes.

Chunks are read and written one document at a time in Python; Spark deals files and documents to
tasks (:func:`read_files`, :func:`document_bytes`).
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import (
    ACTOR, BOOLEAN, DELTA, GROUP, INTEGER, STRING, VALUE, VALUE_META, read_column, read_value, write_column, write_value,
)
from ..functions.leb128 import read_sleb, read_uleb, sleb, uleb

# Marks, types and column numbers of the format, columns in their order.
MAGIC = bytes([0x85, 0x6F, 0x4A, 0x83])
DOCUMENT, CHANGE, COMPRESSED, BUNDLE = range(4)
DEFLATE_FROM = 256
_OP_COLUMNS = {
    "obj_actor": (0, ACTOR), "obj_ctr": (0, INTEGER), "key_actor": (1, ACTOR), "key_ctr": (1, DELTA), "key": (1, STRING),
    "id_actor": (2, ACTOR), "id_ctr": (2, DELTA), "insert": (3, BOOLEAN), "action": (4, INTEGER), "meta": (5, VALUE_META),
    "raw": (5, VALUE), "n_pred": (7, GROUP), "pred_actor": (7, ACTOR), "pred_ctr": (7, DELTA), "n_succ": (8, GROUP),
    "succ_actor": (8, ACTOR), "succ_ctr": (8, DELTA), "expand": (9, BOOLEAN), "mark": (10, STRING),
}
_CHANGE_COLUMNS = {
    "actor": (0, ACTOR), "seq": (0, DELTA), "max_op": (1, DELTA), "time": (2, DELTA), "message": (3, STRING),
    "n_deps": (4, GROUP), "dep": (4, DELTA), "extra_meta": (5, VALUE_META), "extra_raw": (5, VALUE),
}

_OP_SPECS, _CHANGE_SPECS = ({i << 4 | kind: (name, kind) for name, (i, kind) in names.items()} for names in (_OP_COLUMNS, _CHANGE_COLUMNS))
_DEFLATED = 8
Id = tuple[int, str]  # counter, actor; (0, "") is the root object or the head of a sequence


class ChunkError(ValueError):
    """Bytes that aren't a sound chunk."""


@dataclass(slots=True)
class Op:
    id: Id
    obj: Id
    key: str | None
    elem: Id | None
    insert: bool
    action: int
    tag: str | None = None
    value: object = None
    pred: list[Id] = field(default_factory=list)
    expand: bool = False
    mark: str | None = None


@dataclass(slots=True)
class Change:
    actor: str
    seq: int
    start_op: int
    time: int
    message: str | None
    deps: list[str]
    ops: list[Op]
    extra: bytes = b""
    hash: str = ""

    @property
    def max_op(self) -> int:
        return self.start_op + len(self.ops) - 1


def chunk(kind: int, data: bytes) -> tuple[bytes, str]:
    """(the chunk, its hash)."""
    body = bytes([kind]) + uleb(len(data)) + data
    digest = hashlib.sha256(body).digest()
    return MAGIC + digest[:4] + body, digest.hex()


def split_chunks(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(type, checksum, content) of each chunk in turn; raises at the first that isn't sound."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ChunkError("InvalidMagicBytes")
        if at + 9 > len(data):
            raise ChunkError("a header is cut short")
        checksum, kind = data[at + 4 : at + 8], data[at + 8]
        if kind > BUNDLE:
            raise ChunkError(f"UnknownChunkType {kind}")
        try:
            n, start = read_uleb(data, at + 9)
        except ValueError as x:
            raise ChunkError(str(x)) from x
        content = data[start : start + n]
        if len(content) < n:
            raise ChunkError("a chunk is cut short")
        sealed = content
        if kind == COMPRESSED:
            try:
                sealed = zlib.decompress(content, -15)
            except zlib.error as x:
                raise ChunkError("Deflate") from x
            kind = CHANGE
        if chunk(kind, sealed)[0][4:8] != checksum:
            raise ChunkError("BadChecksum")
        yield kind, checksum, sealed
        at = start + n


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        n, self.at = read_uleb(self.data, self.at)
        return n

    def signed(self) -> int:
        n, self.at = read_sleb(self.data, self.at)
        return n

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ChunkError("content is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def hashes(self) -> list[str]:
        return [self.take(32).hex() for _ in range(self.number())]

    def actor(self) -> str:
        return self.take(self.number()).hex()

    def columns(self) -> list[tuple[int, int]]:
        return [(self.number(), self.number()) for _ in range(self.number())]

    def table(self, specs: list[tuple[int, int]], by_spec: dict) -> dict[str, object]:
        """Columns by name; ``raw`` ones as bytes, unknown ones left out."""
        out: dict[str, object] = {}
        for spec, n in specs:
            raw = self.take(n)
            if spec & _DEFLATED:
                raw, spec = zlib.decompress(raw, -15), spec ^ _DEFLATED
            if spec in by_spec:
                name, kind = by_spec[spec]
                out[name] = raw if kind == VALUE else read_column(kind, raw)
        return out


def _put_columns(values: dict[str, object], names: dict, deflate: bool) -> tuple[bytes, bytes]:
    """(column list, data); empty columns are left out, long ones deflated if wanted."""
    heads, bodies = [], []
    for name, (i, kind) in names.items():
        if name not in values:
            continue
        raw = values[name] if kind == VALUE else write_column(kind, values[name])
        spec = i << 4 | kind
        if deflate and len(raw) >= DEFLATE_FROM:
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            raw, spec = packer.compress(raw) + packer.flush(), spec | _DEFLATED
        if raw:
            heads.append(uleb(spec) + uleb(len(raw)))
            bodies.append(raw)
    return uleb(len(heads)) + b"".join(heads), b"".join(bodies)


def _op_table(ops: list[Op], number: dict[str, int], succ: dict[Id, list[Id]] | None) -> dict[str, object]:
    at = lambda i: (None, None) if i == (0, "") else (number[i[1]], i[0])
    metas = [write_value(o.tag, o.value) for o in ops]
    t: dict[str, object] = {
        "obj_actor": [at(o.obj)[0] for o in ops], "obj_ctr": [at(o.obj)[1] for o in ops],
        "key_actor": [at(o.elem)[0] if o.key is None else None for o in ops],
        "key_ctr": [o.elem[0] if o.key is None else None for o in ops],
        "key": [o.key for o in ops], "insert": [o.insert for o in ops], "action": [o.action for o in ops],
        "meta": [m for m, _ in metas], "raw": b"".join(r for _, r in metas), "expand": [o.expand for o in ops], "mark": [o.mark for o in ops],
    }
    order = lambda i: (i[0], i[1])
    lists, name = ([sorted(o.pred, key=order) for o in ops], "pred") if succ is None else ([sorted(succ.get(o.id, []), key=order) for o in ops], "succ")
    t |= {f"n_{name}": [len(x) for x in lists], f"{name}_actor": [number[i[1]] for x in lists for i in x], f"{name}_ctr": [i[0] for x in lists for i in x]}
    if succ is not None:
        t |= {"id_actor": [number[o.id[1]] for o in ops], "id_ctr": [o.id[0] for o in ops]}
    return t


def _ops_of(t: dict, actors: list[str], listed: str) -> Iterator[tuple[Op, list[Id]]]:
    """Operations of a table without their own ids set, each with its listed ids (``pred`` or ``succ``)."""
    n = len(t.get("action", []))
    col = lambda name, default=None: t.get(name) or [default] * n
    full = lambda name, default=None: (c := list(col(name, default))) + [default] * (n - len(c))
    raw, at, ref = t.get("raw", b""), 0, 0
    obj_actor, obj_ctr, key_actor, key_ctr, key = (full(c) for c in ("obj_actor", "obj_ctr", "key_actor", "key_ctr", "key"))
    insert, action, meta, mark, expand = full("insert", False), full("action"), full("meta", 0), full("mark"), full("expand", False)
    counts = full(f"n_{listed}", 0)
    ref_actor, ref_ctr = t.get(f"{listed}_actor", []), t.get(f"{listed}_ctr", [])
    for i in range(n):
        size = (meta[i] or 0) >> 4
        tag, value = read_value(meta[i] or 0, raw[at : at + size])
        at += size
        obj = (0, "") if obj_ctr[i] is None else (obj_ctr[i], actors[obj_actor[i]])
        elem = None if key[i] is not None else (key_ctr[i], actors[key_actor[i]]) if key_actor[i] is not None else (0, "")
        refs = [(ref_ctr[k], actors[ref_actor[k]]) for k in range(ref, ref + (counts[i] or 0))]
        ref += counts[i] or 0
        held = action[i] in (1, 5) or action[i] == 7 and mark[i] is not None
        yield Op((0, ""), obj, key[i], elem, bool(insert[i]), action[i], tag if held else None, value if held else None, [], bool(expand[i]), mark[i]), refs


def encode_tail(c: Change) -> bytes:
    """The content of a change chunk after the deps."""
    ids = {i[1] for o in c.ops for i in (o.obj, o.elem or (0, ""), *o.pred)} - {"", c.actor}
    others = sorted(ids)
    number = {a: k for k, a in enumerate([c.actor, *others])}
    heads, body = _put_columns(_op_table(c.ops, number, None), _OP_COLUMNS, False)
    put_actor = lambda a: uleb(len(a) // 2) + bytes.fromhex(a)
    message = (c.message or "").encode()
    return b"".join(
        [
            put_actor(c.actor), uleb(c.seq), uleb(c.start_op), sleb(c.time), uleb(len(message)), message, uleb(len(others)), *map(put_actor, others),
            heads, body, c.extra,
        ]
    )


def _with_deps(deps: list[str], tail: bytes) -> bytes:
    return b"".join([uleb(len(deps)), *(bytes.fromhex(d) for d in sorted(deps)), tail])


def encode_change(c: Change, deflate: bool = False) -> tuple[bytes, str]:
    """(a change chunk, the change's hash)."""
    return _change_chunk(_with_deps(c.deps, encode_tail(c)), deflate)


def _change_chunk(data: bytes, deflate: bool) -> tuple[bytes, str]:
    out, digest = chunk(CHANGE, data)
    if deflate and len(out) > DEFLATE_FROM:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = packer.compress(data) + packer.flush()
        out = out[:8] + bytes([COMPRESSED]) + uleb(len(packed)) + packed
    return out, digest


def decode_change(content: bytes) -> Change:
    r = _Reader(content)
    deps, actor = r.hashes(), r.actor()
    seq, start, time = r.number(), r.number(), r.signed()
    message = r.take(r.number()).decode() or None
    actors = [actor, *(r.actor() for _ in range(r.number()))]
    table = r.table(r.columns(), _OP_SPECS)
    ops = []
    for i, (op, pred) in enumerate(_ops_of(table, actors, "pred")):
        op.id, op.pred = (start + i, actor), pred
        ops.append(op)
    return Change(actor, seq, start, time, message, deps, ops, content[r.at :], chunk(CHANGE, content)[1])


def _document_order(ops: list[Op]) -> list[Op]:
    """By object, then key or place in the sequence, then id."""
    place: dict[Id, int] = {}
    children: dict[tuple[Id, Id], list[Id]] = {}
    for o in ops:
        if o.insert:
            children.setdefault((o.obj, o.elem), []).append(o.id)
    for obj in {o.obj for o in ops if o.insert}:
        stack = sorted(children.get((obj, (0, "")), []))
        while stack:
            i = stack.pop()
            place[i] = len(place)
            stack += sorted(children.get((obj, i), []))
    return sorted(ops, key=lambda o: (o.obj, o.key or "", place.get(o.id if o.insert else o.elem, -1), not o.insert, o.id))


def _sorted(changes: list) -> tuple[list, list]:
    """(changes, ancestors first; those on loops and below them).

    The order is that of passes over the changes by counter, actor and number, each taking those whose deps are taken.
    """
    left = sorted(changes, key=lambda c: (c.start_op, c.actor, c.seq))
    there = {c.hash for c in left}
    waits = [0] * len(left)
    below: dict[str, list[int]] = {}
    for k, c in enumerate(left):
        for d in {*c.deps} & there:
            waits[k] += 1
            below.setdefault(d, []).append(k)
    ready = [(0, k) for k, n in enumerate(waits) if not n]
    out: list = []
    done: set[str] = set()
    while ready:
        turn, k = heapq.heappop(ready)
        out.append(left[k])
        if left[k].hash not in done:
            done.add(left[k].hash)
            for j in below.pop(left[k].hash, ()):
                waits[j] -= 1
                if not waits[j]:
                    heapq.heappush(ready, (turn + (j < k), j))
    return out, [c for c, n in zip(left, waits) if n]


def _sorted_changes(changes: list) -> list:
    """Ancestors first."""
    out, looped = _sorted(changes)
    if looped:
        raise ChunkError("changes depend on each other in a loop")
    return out


def encode_document(changes: list[Change], deflate: bool = True) -> bytes:
    """A document chunk of a complete history; deletes are there only as successors."""
    changes = _sorted_changes(changes)
    ops = [o for c in changes for o in c.ops]
    succ: dict[Id, list[Id]] = {}
    for o in ops:
        for p in o.pred:
            succ.setdefault(p, []).append(o.id)
    actors = sorted({c.actor for c in changes} | {i[1] for o in ops for i in (o.obj, o.elem or (0, ""), *o.pred)} - {""})
    number = {a: k for k, a in enumerate(actors)}
    row = {c.hash: k for k, c in enumerate(changes)}
    used = {d for c in changes for d in c.deps}
    heads = sorted(c.hash for c in changes if c.hash not in used)
    extras = [write_value("bytes", c.extra) for c in changes]
    meta = {
        "actor": [number[c.actor] for c in changes], "seq": [c.seq for c in changes], "max_op": [c.max_op for c in changes],
        "time": [c.time for c in changes], "message": [c.message for c in changes], "n_deps": [len(c.deps) for c in changes],
        "dep": [d for c in changes for d in sorted(row[x] for x in c.deps)], "extra_meta": [m for m, _ in extras], "extra_raw": b"".join(x for _, x in extras),
    }
    change_heads, change_body = _put_columns(meta, _CHANGE_COLUMNS, deflate)
    op_heads, op_body = _put_columns(_op_table(_document_order([o for o in ops if o.action != 3]), number, succ), _OP_COLUMNS, deflate)
    data = b"".join(
        [
            uleb(len(actors)), *(uleb(len(a) // 2) + bytes.fromhex(a) for a in actors), uleb(len(heads)), *map(bytes.fromhex, heads),
            change_heads, op_heads, change_body, op_body, *(uleb(row[h]) for h in heads),
        ]
    )
    return chunk(DOCUMENT, data)[0]


def decode_document(content: bytes, verify: bool = True) -> list[Change]:
    """The changes of a document, rebuilt with their deletes and hashes; ``verify`` compares the heads."""
    r = _Reader(content)
    actors = [r.actor() for _ in range(r.number())]
    heads = r.hashes()
    change_specs, op_specs = r.columns(), r.columns()
    meta, table = r.table(change_specs, _CHANGE_SPECS), r.table(op_specs, _OP_SPECS)
    by_id: dict[Id, Op] = {}
    deletes: dict[Id, Op] = {}
    links: list[tuple[Op, list[Id]]] = []
    for k, (op, succ) in enumerate(_ops_of(table, actors, "succ")):
        op.id = (table["id_ctr"][k], actors[table["id_actor"][k]])
        by_id[op.id] = op
        links.append((op, succ))
    for op, succ in links:
        for s in succ:
            if s not in by_id and s not in deletes:
                elem = None if op.key is not None else op.id if op.insert else op.elem
                deletes[s] = Op(s, op.obj, op.key, elem, False, 3)
            (by_id.get(s) or deletes[s]).pred.append(op.id)
    mine: dict[str, list[Op]] = {}
    for op in sorted([*by_id.values(), *deletes.values()], key=lambda o: o.id):
        mine.setdefault(op.id[1], []).append(op)
    n = len(meta.get("actor", []))
    fill = lambda name, default: (c := list(meta.get(name, []))) + [default] * (n - len(c))
    seqs, tops, times, messages, n_deps, extra_meta = fill("seq", 0), fill("max_op", 0), fill("time", 0), fill("message", None), fill("n_deps", 0), fill("extra_meta", 0)
    raw, at, dep = meta.get("extra_raw", b""), 0, 0
    rows = []
    for k in range(n):
        size = (extra_meta[k] or 0) >> 4
        rows.append((actors[meta["actor"][k]], seqs[k], tops[k], times[k] or 0, messages[k], meta.get("dep", [])[dep : dep + (n_deps[k] or 0)], raw[at : at + size]))
        at, dep = at + size, dep + (n_deps[k] or 0)
    taken: dict[str, int] = dict.fromkeys(actors, 0)
    contents: dict[int, list[Op]] = {}
    for k in sorted(range(n), key=lambda k: (rows[k][0], rows[k][1])):
        a, top = rows[k][0], rows[k][2]
        pool, start = mine.get(a, []), taken[a]
        while taken[a] < len(pool) and pool[taken[a]].id[0] <= top:
            taken[a] += 1
        contents[k] = pool[start : taken[a]]
    out: list[Change] = []
    for k, (actor, seq, top, time, message, deps, extra) in enumerate(rows):
        c = Change(actor, seq, top - len(contents[k]) + 1, time, message, sorted(out[d].hash for d in deps), contents[k], extra)
        c.hash = encode_change(c)[1]
        out.append(c)
    if verify:
        used = {d for c in out for d in c.deps}
        if sorted(c.hash for c in out if c.hash not in used) != sorted(heads):
            raise ChunkError("MismatchingHeads")
    return out


def count(data: bytes) -> tuple[int, int]:
    """(distinct changes in ``data``, their operations)."""
    sizes: dict[str, int] = {}
    for c in changes_in(data):
        sizes.setdefault(c.hash, len(c.ops))
    return len(sizes), sum(sizes.values())


def encode_bundle(changes: list[Change]) -> bytes:
    """Any changes as one run of chunks; what they depend on need not be there."""
    return b"".join(encode_change(c, deflate=True)[0] for c in _sorted_changes(changes))


def changes_in(data: bytes, verify: bool = True) -> Iterator[Change]:
    """The changes of all chunks in ``data`` in turn; of change chunks one is held at a time."""
    for kind, _, content in split_chunks(data):
        if kind == BUNDLE:
            raise ChunkError("bundle chunks of other writers aren't read")
        yield from decode_document(content, verify) if kind == DOCUMENT else [decode_change(content)]


def decode(data: bytes, verify: bool = True, partial: str = "error") -> list[Change]:
    """The distinct changes of all chunks in ``data``; empty data has none.

    ``partial``: at a chunk that isn't sound ``error`` raises, ``ignore`` returns what came before it.
    """
    out: dict[str, Change] = {}
    try:
        for c in changes_in(data, verify):
            out.setdefault(c.hash, c)
    except (ValueError, IndexError, KeyError, TypeError, zlib.error) as x:
        if partial == "error":
            raise x if isinstance(x, ChunkError) else ChunkError(str(x)) from x
    return list(out.values())


# ---- rows


_ID = "struct<ctr:bigint,actor:string>"
_VAL = "struct<tag:string,i:bigint,u:decimal(20,0),d:double,s:string,b:binary,flag:boolean>"
ROWS = (
    "doc_id bigint, hash string, actor string, seq bigint, start_op bigint, max_op bigint, num_ops bigint, time_ms bigint, message string, deps array<string>, extra binary, "
    f"ops array<struct<op:{_ID},obj:{_ID},op_key:string,elem:{_ID},is_insert:boolean,op_action:tinyint,val:{_VAL},mark_name:string,expand:boolean,pred:array<{_ID}>>>"
)


def _val_row(o: Op) -> dict | None:
    if o.tag is None:
        return None
    slot = {"uint": "u", "f64": "d", "str": "s", "bytes": "b", "bool": "flag", "null": None, "int": "i", "counter": "i", "timestamp": "i"}.get(o.tag, "b")
    v = {"tag": o.tag, "i": None, "u": None, "d": None, "s": None, "b": None, "flag": None}
    if slot:
        from decimal import Decimal

        v[slot] = Decimal(o.value) if slot == "u" else o.value
    return v


def _id_row(i: Id | None) -> dict | None:
    return None if i is None else {"ctr": i[0], "actor": i[1]}


def change_row(doc_id: int, c: Change) -> dict:
    return {
        "doc_id": doc_id, "hash": c.hash, "actor": c.actor, "seq": c.seq, "start_op": c.start_op, "max_op": c.max_op, "num_ops": len(c.ops), "time_ms": c.time,
        "message": c.message, "deps": c.deps, "extra": c.extra or None,
        "ops": [
            {
                "op": _id_row(o.id), "obj": _id_row(o.obj), "op_key": o.key, "elem": _id_row(o.elem), "is_insert": o.insert, "op_action": o.action,
                "val": _val_row(o), "mark_name": o.mark, "expand": o.expand, "pred": [_id_row(p) for p in o.pred],
            }
            for o in c.ops
        ],
    }


def row_change(r) -> Change:
    """The change of a row of the shape :data:`ROWS` (dicts or Rows)."""
    g = lambda x, k: x[k]
    ident = lambda i: None if i is None else (int(i["ctr"]), i["actor"])
    ops = []
    for o in g(r, "ops"):
        v = o["val"]
        tag = v["tag"] if v is not None else None
        value = None
        if tag is not None:
            value = next((v[s] for s in ("i", "u", "d", "s", "b", "flag") if v[s] is not None), None)
        key = o["op_key"]
        ops.append(Op(ident(o["op"]), ident(o["obj"]), key, ident(o["elem"]) if key is None else None, bool(o["is_insert"]), int(o["op_action"]), tag, value, [ident(p) for p in o["pred"]], bool(o["expand"]), o["mark_name"]))
    ops.sort(key=lambda o: o.id)
    message, extra, time = g(r, "message"), g(r, "extra"), g(r, "time_ms")
    return Change(
        g(r, "actor"), int(g(r, "seq")), int(g(r, "start_op")), int(time) if time is not None and time == time else 0, message or None, sorted(g(r, "deps")), ops, bytes(extra) if extra is not None else b"", g(r, "hash"),
    )


def read_files(spark: SparkSession, path: str, verify: bool = True, partial: str = "error", glob: str = "*") -> DataFrame:
    """Files of chunks as rows of :data:`ROWS`, one for each change: a task reads whole files.

    ``doc_id`` is the hash of a file's path.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, content in zip(b["doc_id"].tolist(), b["content"].tolist()):
                yield pd.DataFrame([change_row(doc_id, c) for c in decode(bytes(content), verify, partial)], columns=[x.split(" ")[0] for x in ROWS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "content").mapInPandas(read, ROWS)


def nested(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """Distinct changes with their distinct operations as rows of :data:`ROWS`."""
    cols = ["op", "obj", "op_key", "elem", "is_insert", "op_action", "val", "mark_name", "expand", "pred"]
    given = ops.groupBy("doc_id", F.col("change_hash").alias("hash")).agg(F.sort_array(F.collect_set(F.struct(*cols))).alias("_o"))
    first = F.filter("_o", lambda o, i: (i == 0) | ~o["op"].eqNullSafe(F.get(F.col("_o"), i - 1)["op"]))
    held = given.select("doc_id", "hash", first.alias("ops"))
    own = ["doc_id", "hash", "actor", "seq", "start_op", "max_op", "num_ops", "time_ms", "message", "deps", "extra"]
    none = F.expr("array()").cast(held.schema["ops"].dataType)
    return changes.select(*own).join(held, ["doc_id", "hash"], "left").withColumn("ops", F.coalesce("ops", none))


def tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, ops) of rows of :data:`ROWS`."""
    o = rows.select("doc_id", F.col("hash").alias("change_hash"), F.explode("ops").alias("o")).select("doc_id", "o.*", "change_hash")
    return rows.drop("ops"), o


def change_bytes(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``hash`` (of the bytes), ``stored_hash`` (as the row has it), ``n_bytes``, ``bytes`` of each change as a chunk."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [encode_change(row_change(r), deflate=True) for r in b.to_dict("records")]
            yield pd.DataFrame({"doc_id": b["doc_id"], "hash": [h for _, h in made], "stored_hash": b["hash"], "n_bytes": [len(x) for x, _ in made], "bytes": [x for x, _ in made]})

    return rows.mapInPandas(put, "doc_id bigint, hash string, stored_hash string, n_bytes int, bytes binary")


@dataclass(slots=True)
class Packed:
    """A change whose operations are bytes.

    ``ids`` are those of its operations, if these aren't ``start_op`` and on of its actor.  ``made`` has four-byte sums of the
    ids of those that a document chunk lists, ``named`` of all ids in ``pred``.
    """

    hash: str
    actor: str
    seq: int
    start_op: int
    deps: list[str]
    tail: bytes
    ids: list[Id] | None = None
    made: bytes = b""
    named: bytes = b""

    @property
    def content(self) -> bytes:
        return _with_deps(self.deps, self.tail)

    def change(self) -> Change:
        c = decode_change(self.content)
        for op, i in zip(c.ops, self.ids or ()):
            op.id = i
        return c


def _leaf(a: pa.Array) -> list:
    if not (pa.types.is_integer(a.type) or pa.types.is_floating(a.type) or pa.types.is_boolean(a.type)):
        return a.to_numpy(zero_copy_only=False).tolist()
    values = a.fill_null(False if pa.types.is_boolean(a.type) else 0).to_numpy(zero_copy_only=False).tolist()
    return [v if there else None for v, there in zip(values, a.is_valid().to_numpy(zero_copy_only=False).tolist())] if a.null_count else values


def _ids(a: pa.StructArray) -> list[Id | None]:
    ctr, actor = map(_leaf, a.flatten())
    return [None if c is None else (c, x) for c, x in zip(ctr, actor)]


def _lists(a: pa.ListArray, items: list) -> Iterator[list]:
    at = 0
    for n in _leaf(a.value_lengths()):
        yield items[at : at + (n or 0)]
        at += n or 0


def batch_changes(batch: pa.RecordBatch) -> Iterator[Change]:
    """The changes of rows of :data:`ROWS`, as :func:`row_change` has them, column by column."""
    col = dict(zip(batch.schema.names, batch.columns))
    flat = col["ops"].flatten()
    op = dict(zip((x.name for x in flat.type), flat.flatten()))
    val = dict(zip((x.name for x in op["val"].type), map(_leaf, op["val"].flatten())))
    slots = zip(*(val[x] for x in ("i", "u", "d", "s", "b", "flag")))
    values = [None if tag is None else next((v for v in x if v is not None), None) for tag, x in zip(val["tag"], slots)]
    ops = [
        Op(i, obj, key, elem if key is None else None, bool(insert), action, tag, value, pred, bool(expand), mark)
        for i, obj, key, elem, insert, action, tag, value, pred, expand, mark in zip(
            _ids(op["op"]), _ids(op["obj"]), _leaf(op["op_key"]), _ids(op["elem"]), _leaf(op["is_insert"]), _leaf(op["op_action"]), val["tag"], values,
            _lists(op["pred"], _ids(op["pred"].flatten())), _leaf(op["expand"]), _leaf(op["mark_name"]),
        )
    ]
    own = (_leaf(col[x]) for x in ("actor", "seq", "start_op", "time_ms", "message", "extra", "hash"))
    for actor, seq, start, time, message, extra, hash_, deps, mine in zip(*own, _lists(col["deps"], _leaf(col["deps"].flatten())), _lists(col["ops"], ops)):
        yield Change(actor, seq, start, time or 0, message or None, sorted(deps), sorted(mine, key=lambda o: o.id), extra or b"", hash_)


#: Rows of changes that are Python objects at once.
_AT_ONCE = 512
_ODD = "array<struct<ctr:bigint,actor:string>>"
_PACKED = f"doc_id bigint, hash string, actor string, seq bigint, start_op bigint, deps array<string>, tail binary, ids {_ODD}, made binary, named binary"


def _crc(ids: Iterator[Id]) -> bytes:
    return np.fromiter((zlib.crc32(b"%d@%s" % (i[0], i[1].encode())) for i in ids), np.uint32).tobytes()


def packed(rows: DataFrame) -> DataFrame:
    """Rows of :data:`ROWS` with their operations as bytes (:class:`Packed`), so that documents are gathered from little."""
    id_type = pa.list_(pa.struct([("ctr", pa.int64()), ("actor", pa.string())]))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _AT_ONCE):
                b = batch.slice(at, _AT_ONCE)
                cs = list(batch_changes(b))
                odd = [[{"ctr": o.id[0], "actor": o.id[1]} for o in c.ops] if any(o.id != (c.start_op + k, c.actor) for k, o in enumerate(c.ops)) else None for c in cs]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), b.column("hash"), b.column("actor"), b.column("seq"), b.column("start_op"),
                        pa.array([c.deps for c in cs], pa.list_(pa.string())), pa.array([encode_tail(c) for c in cs], pa.binary()), pa.array(odd, id_type),
                        pa.array([_crc(o.id for o in c.ops if o.action != 3) for c in cs], pa.binary()),
                        pa.array([_crc(p for o in c.ops for p in o.pred) for c in cs], pa.binary()),
                    ],
                    ["doc_id", "hash", "actor", "seq", "start_op", "deps", "tail", "ids", "made", "named"],
                )

    return rows.mapInArrow(put, _PACKED)


def document_bytes(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``n_changes``, ``bytes``: each document as one chunk.

    Changes are hashed anew in order of their ancestry, and deps outside the history are dropped, so
    that what is written is sound whatever hashes the rows carry.  What is written is read back; a
    history that a document chunk can't hold (with a ``pred`` that names nothing, or counters used
    twice) is written as a chunk for each change.  A document is one value, so one task writes it; that task
    has changes as bytes, and their operations as objects only if a document chunk can hold them.
    """

    def put(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes = []
        for b in batches:
            got = [_leaf(b.column(x)) for x in ("hash", "actor", "seq", "start_op")]
            deps = _lists(b.column("deps"), _leaf(b.column("deps").flatten()))
            ids = (None if x is None else [(i["ctr"], i["actor"]) for i in x] for x in b.column("ids").to_pylist())
            changes += map(Packed, *got, deps, _leaf(b.column("tail")), ids, _leaf(b.column("made")), _leaf(b.column("named")))
        changes = rehash(changes, lambda c: chunk(CHANGE, c.content)[1])
        data = save_packed(changes)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([len(changes)], pa.int32()), pa.array([data], pa.binary())], ["doc_id", "n_changes", "bytes"])

    return packed(rows).groupBy("doc_id").applyInArrow(put, "doc_id bigint, n_changes int, bytes binary")


def save_packed(changes: list[Packed]) -> bytes:
    """As :func:`save_and_verify`; without a try if a ``pred`` surely names nothing, which no document chunk can hold."""
    named, made = (np.frombuffer(b"".join(x), np.uint32) for x in ((c.named for c in changes), (c.made for c in changes)))
    if np.isin(named, made).all():
        return save_and_verify([c.change() for c in changes])
    return b"".join(_change_chunk(c.content, True)[0] for c in _sorted_changes(changes))


def save_and_verify(changes: list[Change]) -> bytes:
    """A document chunk if reading it gives the same changes, else the changes' own chunks."""
    try:
        data = encode_document(changes)
        if {c.hash for c in decode(data)} == {c.hash for c in changes}:
            return data
    except (ChunkError, KeyError):
        pass
    return encode_bundle(changes)


def rehash(changes: list, digest: Callable[..., str] = lambda c: encode_change(c)[1]) -> list:
    """The changes with the hashes their bytes have, deps following; changes on loops, or below them, are left out."""
    ordered, looped = _sorted(changes)
    while looped:
        done = {c.hash for c in ordered}
        changes = [c for c in changes if c.hash in done]
        ordered, looped = _sorted(changes)
    new: dict[str, str] = {}
    for c in ordered:
        c.deps = sorted(new[d] for d in c.deps if d in new)
        old = c.hash
        c.hash = new[old] = digest(c)
    return ordered
