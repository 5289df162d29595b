"""Writing to one document: operations made from values, committed as one change.

Reading is Spark's business; what a writer needs of a document (its registers, the order of its
sequences) is fetched once into a :class:`Snapshot`, and a :class:`Transaction` makes operation rows
from it that are appended to the log in one batch.
"""

from __future__ import annotations

import copy
from bisect import insort
from collections.abc import Callable, Iterable
from itertools import zip_longest
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.leb128 import uleb
from ..functions.textdiff import edits, graphemes
from ..operators import graph, sequence, state
from ..sources.chunks import Change, Id, Op, encode_change

ROOT_ID: Id = (0, "")
_TYPES = {"map": 0, "list": 2, "text": 4, "table": 6}
_NAMES = {v: k for k, v in _TYPES.items()}


class DocumentError(ValueError):
    """A write that a document doesn't allow; the message begins with the kind of error."""


class Scalar:
    """A value with an explicit type: ``Scalar("counter", 3)``."""

    def __init__(self, tag: str, value: Any = None):
        self.tag, self.value = tag, value


def scalar(value: Any) -> Scalar:
    """The scalar type of a Python value."""
    if isinstance(value, Scalar):
        return value
    if value is None:
        return Scalar("null")
    if isinstance(value, bool):
        return Scalar("bool", value)
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 64:
            raise DocumentError("InvalidValueType: an integer of more than 64 bits")
        return Scalar("int" if value < 1 << 63 else "uint", value)
    if isinstance(value, float):
        return Scalar("f64", value)
    if isinstance(value, str):
        return Scalar("str", value)
    if isinstance(value, (bytes, bytearray)):
        return Scalar("bytes", bytes(value))
    raise DocumentError(f"InvalidValueType: {type(value).__name__}")


class Snapshot:
    """What a writer knows of one document."""

    def __init__(self, heads: Iterable[str] = (), max_op: int = 0, seqs: dict[str, int] | None = None):
        self.heads, self.max_op, self.seqs = sorted(heads), max_op, dict(seqs or {})
        self.types: dict[Id, int] = {ROOT_ID: 0}
        self.registers: dict[tuple[Id, str | Id], list[Op]] = {}
        self.order: dict[Id, list[Id]] = {}
        self.marks: dict[Id, Op] = {}
        self.references: dict[Id, Id] = {}

    @classmethod
    def of_changes(cls, changes: Iterable[Change]) -> Snapshot:
        """From a history at hand (ancestors first)."""
        s = cls()
        for c in changes:
            s.apply(c)
        return s

    @classmethod
    def read(cls, changes: DataFrame, ops: DataFrame, doc_id: int, version: DataFrame | None = None) -> Snapshot:
        """From the log tables: distinct changes and operations of the document, current or as of a version."""
        c = changes.where(F.col("doc_id") == doc_id)
        o = ops.where(F.col("doc_id") == doc_id)
        top, seqs = c.agg(F.max("max_op")).first()[0] or 0, {r.actor: r.seq for r in graph.last_changes(c).collect()}
        if version is not None:
            o = graph.covered_ops(o, graph.clock(c, version))
            c = c.join(graph.ancestors(c, version), graph.KEY, "left_semi")
        s = cls([r.hash for r in graph.heads(c).collect()], top, seqs)
        for r in state.visible_ops(o).collect():
            elem = (r.elem.ctr, r.elem.actor) if r.elem is not None else None
            tag = r.val.tag if r.val is not None else None
            value = r.n if r.n is not None else None if tag is None else next((v for v in (r.val.i, r.val.u, r.val.d, r.val.s, r.val.b, r.val.flag) if v is not None), None)
            s._show(Op((r.op.ctr, r.op.actor), (r.obj.ctr, r.obj.actor), None if elem else r.reg, elem, False, r.op_action, tag, value))
        for r in sequence.element_order(o).orderBy("obj", "pos").collect():
            s.order.setdefault((r.obj.ctr, r.obj.actor), []).append((r.elem.ctr, r.elem.actor))
        for r in state.log_ops(o.where("is_insert")).select("op", "elem").collect():
            s.references[(r.op.ctr, r.op.actor)] = (r.elem.ctr, r.elem.actor)
        for r in state.log_ops(o.where(F.col("op_action") == state.MARK)).collect():
            tag = r.val.tag if r.val is not None else None
            value = None if tag is None else next((v for v in (r.val.i, r.val.u, r.val.d, r.val.s, r.val.b, r.val.flag) if v is not None), None)
            s.marks[(r.op.ctr, r.op.actor)] = Op((r.op.ctr, r.op.actor), (r.obj.ctr, r.obj.actor), None, None, True, 7, tag, value, mark=r.mark_name, expand=r.expand)
        for r in state.log_ops(o.where(F.col("op_action").isin(*_NAMES))).collect():
            s.types[(r.op.ctr, r.op.actor)] = r.op_action
        return s

    def _show(self, op: Op) -> None:
        slot = self.registers.setdefault((op.obj, op.key if op.key is not None else op.elem), [])
        insort(slot, op, key=lambda o: o.id)

    def apply(self, c: Change) -> None:
        for op in c.ops:
            self.apply_op(op)
        self.max_op = max(self.max_op, c.max_op)
        self.seqs[c.actor] = max(self.seqs.get(c.actor, 0), c.seq)
        self.heads = sorted({h for h in self.heads if h not in c.deps} | {c.hash})

    def apply_op(self, op: Op) -> None:
        reg = op.key if op.key is not None else op.id if op.insert else op.elem
        slot = self.registers.setdefault((op.obj, reg), [])
        if op.action == 5:
            for t in slot:
                if t.id in op.pred and t.tag == "counter":
                    t.value += op.value
            slot[:] = [t for t in slot if t.id not in op.pred or t.tag == "counter"]
        else:
            slot[:] = [t for t in slot if t.id not in op.pred]
        if op.insert:
            self.references[op.id] = op.elem
            seq = self.order.setdefault(op.obj, [])
            at = seq.index(op.elem) + 1 if op.elem != ROOT_ID else 0
            while at < len(seq) and seq[at] > op.id:
                at += 1
            seq.insert(at, op.id)
        if op.action == 7:
            self.marks[op.id] = op
        elif op.action not in (3, 5):
            shown = Op(op.id, op.obj, op.key, None if op.key is not None else reg, False, op.action, op.tag, op.value)
            insort(slot, shown, key=lambda o: o.id)
        if op.action in _NAMES:
            self.types[op.id] = op.action

    # -- reading

    def type_of(self, obj: Id) -> str:
        if obj not in self.types:
            raise DocumentError(f"InvalidObjId: {obj}")
        return _NAMES[self.types[obj]]

    def elements(self, obj: Id) -> list[Id]:
        """Ids of the visible elements in order."""
        return [e for e in self.order.get(obj, []) if self.registers.get((obj, e))]

    def keys(self, obj: Id) -> list[str]:
        return sorted((k for (o, k), slot in self.registers.items() if o == obj and slot and isinstance(k, str)), key=lambda k: k.encode())

    def value(self, op: Op) -> Any:
        return self.hydrate(op.id) if op.action in _NAMES else op.value

    def get(self, obj: Id, prop: str | int) -> Any:
        slot = self.registers.get((obj, self._register(obj, prop)), [])
        return self.value(slot[-1]) if slot else None

    def get_all(self, obj: Id, prop: str | int) -> list[Any]:
        return [self.value(o) for o in self.registers.get((obj, self._register(obj, prop)), [])]

    def object(self, obj: Id, prop: str | int) -> Id:
        return self.registers[(obj, self._register(obj, prop))][-1].id

    def length(self, obj: Id) -> int:
        kind = self.type_of(obj)
        return len(self.text(obj)) if kind == "text" else len(self.elements(obj)) if kind == "list" else len(self.keys(obj))

    def text(self, obj: Id) -> str:
        return "".join(o.value if o.tag == "str" else "￼" for e in self.order.get(obj, []) for o in self.registers.get((obj, e), []))

    def hydrate(self, obj: Id = ROOT_ID) -> Any:
        kind = self.type_of(obj)
        if kind == "text":
            return self.text(obj)
        if kind == "list":
            return [self.value(self.registers[(obj, e)][-1]) for e in self.elements(obj)]
        return {k: self.get(obj, k) for k in self.keys(obj)}

    def marks_of(self, obj: Id) -> list[tuple[str, Any, int, int]]:
        """(name, value, start, end) of every marked stretch of a text's visible elements; of marks of one name the latest holds."""
        active: dict[str, dict[Id, Any]] = {}
        names: dict[Id, str] = {}
        at, now = 0, {}
        out: list[tuple[str, Any, int, int]] = []

        def close(name: str) -> None:
            value, start = now.pop(name)
            out.append((name, value, start, at))

        for e in self.order.get(obj, []):
            m = self.marks.get(e)
            if m is not None and m.mark is not None:
                active.setdefault(m.mark, {})[e] = m.value
                names[e] = m.mark
            elif m is not None and (begin := (e[0] - 1, e[1])) in names:
                active[names[begin]].pop(begin, None)
            if m is not None or not self.registers.get((obj, e)):
                continue
            here = {n: ids[max(ids)] for n, ids in active.items() if ids and ids[max(ids)] is not None}
            for n in [n for n, (v, _) in now.items() if n not in here or here[n] != v]:
                close(n)
            for n, v in here.items():
                now.setdefault(n, (v, at))
            at += 1
        for n in list(now):
            close(n)
        return sorted(out, key=lambda r: (r[2], r[0], r[3]))

    def units(self, obj: Id) -> list[tuple[str | None, Any, int]]:
        """A text as graphemes (text, None, elements) and blocks (None, value of the block, 1)."""
        out: list[tuple[str | None, Any, int]] = []
        run = ""
        for e in self.elements(obj):
            top = self.registers[(obj, e)][-1]
            if top.action != _TYPES["map"]:
                run += top.value if top.tag == "str" else "￼"
                continue
            out += [(g, None, len(g)) for g in graphemes(run)]
            out.append((None, self.hydrate(top.id), 1))
            run = ""
        return out + [(g, None, len(g)) for g in graphemes(run)]

    def spans(self, obj: Id) -> list[dict[str, Any]]:
        """A text as ``{"text", "marks"}`` for each stretch with the same marks and ``{"block"}`` for each block."""
        marks = self.marks_of(obj)
        out: list[dict[str, Any]] = []
        for at, e in enumerate(self.elements(obj)):
            top = self.registers[(obj, e)][-1]
            if top.action == _TYPES["map"]:
                out.append({"block": self.hydrate(top.id)})
                continue
            text = top.value if top.tag == "str" else "￼"
            here = {name: value for name, value, start, end in marks if start <= at < end}
            if out and out[-1].get("marks") == here:
                out[-1]["text"] += text
            else:
                out.append({"text": text, "marks": here})
        return out

    def cursor(self, obj: Id, index: int | str, move: str = "after") -> str:
        """A stable address of a place: ``ctr@actor`` of the element there, ``-`` before it if it moves before, ``s`` or ``e`` for start and end."""
        if index in ("start", "end"):
            return index[0]
        i = self._register(obj, index)
        return f"{'-' if move == 'before' else ''}{i[0]}@{i[1]}"

    def cursor_position(self, obj: Id, cursor: str) -> int:
        """Where a cursor points now.  A deleted element's cursor has moved to the next visible element or, if it
        moves before, along the references to the first visible one, else to the start."""
        seen = self.elements(obj)
        if cursor in ("s", "e"):
            return 0 if cursor == "s" else len(seen)
        try:
            ctr, actor = cursor.lstrip("-").split("@")
            at = (int(ctr), actor)
            seq = self.order[obj]
            place = seq.index(at)
        except (ValueError, KeyError) as x:
            raise DocumentError(f"InvalidCursor: {cursor}") from x
        if at in seen:
            return seen.index(at)
        if not cursor.startswith("-"):
            return sum(1 for e in seq[:place] if self.registers.get((obj, e)))
        while at in self.references and at not in seen:
            at = self.references[at]
        return seen.index(at) if at in seen else 0

    def _register(self, obj: Id, prop: str | int) -> str | Id:
        if (self.type_of(obj) in ("map", "table")) != isinstance(prop, str):
            raise DocumentError("InvalidOp: a key for a sequence or an index for a map")
        if isinstance(prop, str):
            return prop
        seen = self.elements(obj)
        if not 0 <= prop < len(seen):
            raise DocumentError(f"InvalidIndex: {prop}")
        return seen[prop]


class Transaction:
    """Operations of one actor on a snapshot.  The snapshot shows what has been done so far."""

    def __init__(self, snapshot: Snapshot, actor: str):
        self.doc, self.actor = snapshot, actor
        self.start = snapshot.max_op + 1
        self.deps = list(snapshot.heads)
        self.ops: list[Op] = []
        self._before: list[tuple[tuple[Id, str | Id], list[Op] | None]] = []

    def pending_ops(self) -> int:
        return len(self.ops)

    def _add(self, obj: Id, key: str | None, elem: Id | None, insert: bool, action: int, value: Scalar | None = None, pred: list[Id] | None = None, **more) -> Id:
        op = Op((self.start + len(self.ops), self.actor), obj, key, elem, insert, action, value.tag if value else None, value.value if value else None, sorted(pred or []), **more)
        place = (op.obj, op.key if op.key is not None else op.id if op.insert else op.elem)
        slot = self.doc.registers.get(place)
        self._before.append((place, None if slot is None else [copy.copy(o) for o in slot]))
        self.ops.append(op)
        self.doc.apply_op(op)
        return op.id

    def rollback(self) -> int:
        """Undoes all operations so far, on the snapshot too; how many there were."""
        n = len(self.ops)
        for op, (place, slot) in zip(reversed(self.ops), reversed(self._before)):
            if slot is None:
                self.doc.registers.pop(place, None)
            else:
                self.doc.registers[place] = slot
            if op.insert:
                self.doc.order[op.obj].remove(op.id)
                self.doc.references.pop(op.id, None)
            self.doc.marks.pop(op.id, None)
            self.doc.types.pop(op.id, None)
        self.ops, self._before = [], []
        return n

    def _target(self, obj: Id, prop: str | int) -> tuple[str | None, Id | None, list[Op]]:
        reg = self.doc._register(obj, prop)
        slot = list(self.doc.registers.get((obj, reg), []))
        return (reg, None, slot) if isinstance(reg, str) else (None, reg, slot)

    def put(self, obj: Id, prop: str | int, value: Any) -> None:
        """Writes a register.  The value it has already makes no operation; if rivals are there they are deleted."""
        if self.doc.type_of(obj) in ("text", "table"):
            raise DocumentError(f"InvalidOp: put on a {self.doc.type_of(obj)}")
        v = scalar(value)
        key, elem, slot = self._target(obj, prop)
        if slot and slot[-1].tag == v.tag and slot[-1].value == v.value and v.tag != "counter" and slot[-1].action == 1:
            if len(slot) > 1:
                self._add(obj, key, elem, False, 3, pred=[o.id for o in slot[:-1]])
            return
        self._add(obj, key, elem, False, 1, v, [o.id for o in slot])

    def put_object(self, obj: Id, prop: str | int, kind: str) -> Id:
        if self.doc.type_of(obj) in ("text", "table"):
            raise DocumentError("InvalidOp: an object in a text or table")
        key, elem, slot = self._target(obj, prop)
        return self._add(obj, key, elem, False, _TYPES[kind], pred=[o.id for o in slot])

    def _reference(self, obj: Id, index: int) -> Id:
        """The element after which an insert at ``index`` goes: marks at the border take it in if they expand."""
        seen = self.doc.elements(obj)
        if not 0 <= index <= len(seen):
            raise DocumentError(f"InvalidIndex: {index}")
        seq = self.doc.order.get(obj, [])
        ref = seen[index - 1] if index else ROOT_ID
        at = seq.index(ref) + 1 if index else 0
        while at < len(seq) and (index == len(seen) or seq[at] != seen[index]):
            m = self.doc.marks.get(seq[at])
            if m is not None and m.expand == (m.mark is not None):
                ref = seq[at]
            at += 1
        return ref

    def insert(self, obj: Id, index: int, value: Any) -> None:
        if self.doc.type_of(obj) != "list":
            raise DocumentError("InvalidOp: insert into what isn't a list")
        self._add(obj, None, self._reference(obj, index), True, 1, scalar(value))

    def insert_object(self, obj: Id, index: int, kind: str) -> Id:
        if self.doc.type_of(obj) != "list":
            raise DocumentError("InvalidOp: insert into what isn't a list")
        return self._add(obj, None, self._reference(obj, index), True, _TYPES[kind])

    def increment(self, obj: Id, prop: str | int, by: int) -> None:
        key, elem, slot = self._target(obj, prop)
        if not any(o.tag == "counter" for o in slot):
            raise DocumentError("MissingCounter")
        self._add(obj, key, elem, False, 5, Scalar("int", by), [o.id for o in slot])

    def delete(self, obj: Id, prop: str | int) -> None:
        if isinstance(prop, int) and self.doc.type_of(obj) == "text":
            self.splice_text(obj, prop, 1, "")
            return
        key, elem, slot = self._target(obj, prop)
        if slot:
            self._add(obj, key, elem, False, 3, pred=[o.id for o in slot])

    def _splice(self, obj: Id, index: int, delete: int, values: list[Scalar]) -> None:
        if delete < 0:
            index, delete = index + delete, -delete
            if index < 0:
                raise DocumentError(f"InvalidIndex: {index}")
        gone = self.doc.elements(obj)[index : index + delete]
        if values:
            ref = self._reference(obj, index)
            for v in values:
                ref = self._add(obj, None, ref, True, 1, v)
        for e in gone:
            self._add(obj, None, e, False, 3, pred=[o.id for o in self.doc.registers[(obj, e)]])

    def splice(self, obj: Id, index: int, delete: int, values: Iterable[Any] = ()) -> None:
        if self.doc.type_of(obj) != "list":
            raise DocumentError("InvalidOp: splice of what isn't a list")
        self._splice(obj, index, delete, [scalar(v) for v in values])

    def splice_text(self, obj: Id, index: int, delete: int, text: str = "") -> None:
        """One operation for each code point."""
        if self.doc.type_of(obj) != "text":
            raise DocumentError("InvalidOp: text into what isn't a text")
        self._splice(obj, index, delete, [Scalar("str", c) for c in text])

    def mark(self, obj: Id, start: int, end: int, name: str, value: Any, expand: str = "after") -> None:
        """A mark from ``start`` to ``end``; ``expand`` (before, after, both, none) takes in what is later written at its borders."""
        if self.doc.type_of(obj) != "text":
            raise DocumentError("InvalidOp: a mark on what isn't a text")
        if start == end and expand == "none":
            return
        if start > end:
            raise DocumentError("InvalidIndex: a mark that ends before it starts")
        self._add(obj, None, self._reference(obj, start), True, 7, scalar(value), expand=expand in ("before", "both"), mark=name)
        self._add(obj, None, self._reference(obj, end), True, 7, expand=expand in ("after", "both"))

    def unmark(self, obj: Id, start: int, end: int, name: str, expand: str = "none") -> None:
        self.mark(obj, start, end, name, None, expand)

    def split_block(self, obj: Id, index: int) -> Id:
        if self.doc.type_of(obj) != "text":
            raise DocumentError("InvalidOp: a block in what isn't a text")
        return self._add(obj, None, self._reference(obj, index), True, _TYPES["map"])

    def join_block(self, obj: Id, index: int) -> None:
        _, elem, slot = self._target(obj, index)
        self._add(obj, None, elem, False, 3, pred=[o.id for o in slot])

    def replace_block(self, obj: Id, index: int) -> Id:
        self.join_block(obj, index)
        return self.split_block(obj, index)

    def update_text(self, obj: Id, new: str) -> None:
        """The splices that make the text ``new``, by the shortest edit script of graphemes."""
        old = graphemes(self.doc.text(obj))
        for at, n, add in edits(old, graphemes(new)):
            self.splice_text(obj, len("".join(old[:at])), len("".join(old[at : at + n])), "".join(add))

    def update_spans(self, obj: Id, new: Iterable[dict[str, Any]], expand: str = "after", expands: dict[str, str] | None = None) -> None:
        """Makes a text equal to spans as :meth:`Snapshot.spans` has them (``marks`` may be left out).

        Graphemes and blocks change by the shortest edit script, a block in place of a block is
        updated; then marks that aren't wanted are taken off and missing ones set.  ``expands`` names how
        marks of some names expand, ``expand`` how others do.
        """
        if self.doc.type_of(obj) != "text":
            raise DocumentError("InvalidOp: spans of what isn't a text")
        old = self.doc.units(obj)
        want: list[tuple[str | None, Any, int]] = []
        wanted: list[tuple[str, Any, int, int]] = []
        at = 0
        for span in new:
            if "block" in span:
                want.append((None, span["block"], 1))
                at += 1
                continue
            want += [(g, None, len(g)) for g in graphemes(span["text"])]
            end = at + len(span["text"])
            wanted += [(name, value, at, end) for name, value in (span.get("marks") or {}).items() if value is not None and end > at]
            at = end
        for place, n, add in edits(old, want):
            index = sum(w for _, _, w in old[:place])
            for gone, fresh in zip_longest(old[place : place + n], add):
                if gone and fresh and gone[0] is None and fresh[0] is None:
                    self.update_object(self.doc.object(obj, index), fresh[1])
                    index += 1
                    continue
                if gone and gone[0] is None:
                    self.join_block(obj, index)
                elif gone:
                    self.splice_text(obj, index, gone[2])
                if fresh and fresh[0] is None:
                    self.update_object(self.split_block(obj, index), fresh[1])
                    index += 1
                elif fresh:
                    self.splice_text(obj, index, 0, fresh[0])
                    index += fresh[2]
        joined: list[tuple[str, Any, int, int]] = []
        for name, value, start, end in sorted(wanted, key=lambda r: (r[0], r[2])):
            if joined and joined[-1][:2] == (name, value) and joined[-1][3] == start:
                start = joined.pop()[2]
            joined.append((name, value, start, end))
        how = lambda name: (expands or {}).get(name, expand)
        for name, _, start, end in [m for m in self.doc.marks_of(obj) if m not in joined]:
            self.unmark(obj, start, end, name, how(name))
        now = self.doc.marks_of(obj)
        for name, value, start, end in joined:
            if (name, value, start, end) not in now:
                self.mark(obj, start, end, name, value, how(name))

    def update_object(self, obj: Id, new: Any) -> None:
        """Makes an object equal to a value of the same kind, changing only what differs."""
        kind = self.doc.type_of(obj)
        fits = {"map": dict, "table": dict, "list": list, "text": str}[kind]
        if not isinstance(new, fits):
            raise DocumentError("ChangeType")
        if kind == "text":
            self.update_text(obj, new)
        elif kind == "list":
            for i in range(len(self.doc.elements(obj)) - 1, len(new) - 1, -1):
                self.delete(obj, i)
            for i, v in enumerate(new):
                self._assign(obj, i, v, i >= len(self.doc.elements(obj)))
        else:
            for k in self.doc.keys(obj):
                if k not in new:
                    self.delete(obj, k)
            for k, v in new.items():
                self._assign(obj, k, v, False)

    def _assign(self, obj: Id, prop: str | int, value: Any, insert: bool) -> None:
        if not isinstance(value, (dict, list)):
            self.insert(obj, prop, value) if insert else self.put(obj, prop, value)
            return
        kind = "map" if isinstance(value, dict) else "list"
        slot = [] if insert else self.doc.registers.get((obj, self.doc._register(obj, prop)), [])
        if slot and _NAMES.get(slot[-1].action) == kind:
            self.update_object(slot[-1].id, value)
            return
        child = self.insert_object(obj, prop, kind) if insert else self.put_object(obj, prop, kind)
        self.update_object(child, value)

    def commit(self, time_ms: int = 0, message: str | None = None, empty: bool = False) -> Change | None:
        """The change of all operations so far, or None without any (unless an ``empty`` one is wanted)."""
        if not self.ops and not empty:
            return None
        c = Change(self.actor, self.doc.seqs.get(self.actor, 0) + 1, self.start, time_ms, message, self.deps, self.ops)
        c.hash = encode_change(c)[1]
        self.doc.max_op = max(self.doc.max_op, c.max_op)
        self.doc.seqs[self.actor] = c.seq
        self.doc.heads = [c.hash]
        self._before = []
        return c


def transact(snapshot: Snapshot, actor: str, edit: Callable[[Transaction], Any], time_ms: int = 0, message: str | None = None) -> tuple[Change | None, Any]:
    """The change of what ``edit`` does and what it returns; if it fails nothing has been done."""
    t = Transaction(snapshot, actor)
    try:
        result = edit(t)
    except BaseException:
        t.rollback()
        raise
    return t.commit(time_ms, message), result


#: A fixed value: what the ids of actors begin with that write beside their own later operations.
_BESIDE = "13b22309"


def isolated(changes: DataFrame, ops: DataFrame, doc_id: int, version: DataFrame, actor: str) -> Transaction:
    """A transaction that sees and depends on a version only, as if nothing had been written since.

    An actor with operations that the version doesn't cover writes under an id derived from its own (of the first level
    that has none).  What is committed meets the rest of the history by merging, as other changes do.
    """
    c = changes.where(F.col("doc_id") == doc_id)
    seen = {r.actor: r.max_op for r in graph.clock(c, version).collect()}
    last = {r.actor: r.top for r in c.groupBy("actor").agg(F.max("max_op").alias("top")).collect()}
    mine, level = actor, 0
    while last.get(mine) and last[mine] > seen.get(mine, 0):
        level += 1
        mine = _BESIDE + uleb(level).hex() + actor
    return Transaction(Snapshot.read(changes, ops, doc_id, version), mine)


def import_json(value: dict, actor: str, strings_as_text: bool = False) -> Change:
    """A document of a JSON object as one change; strings become scalars, or texts if wanted."""
    if not isinstance(value, dict):
        raise DocumentError("InvalidOp: a document is an object")
    t = Transaction(Snapshot(), actor)

    def fill(obj: Id, items: Iterable[tuple[str | int, Any]], into_list: bool) -> None:
        for prop, v in items:
            kind = "map" if isinstance(v, dict) else "list" if isinstance(v, list) else "text" if strings_as_text and isinstance(v, str) else None
            if kind is None:
                t.insert(obj, prop, v) if into_list else t.put(obj, prop, v)
                continue
            child = t.insert_object(obj, prop, kind) if into_list else t.put_object(obj, prop, kind)
            if kind == "text":
                t.splice_text(child, 0, 0, v)
            else:
                fill(child, v.items() if kind == "map" else enumerate(v), kind == "list")

    fill(ROOT_ID, value.items(), False)
    return t.commit(empty=True)


def strings_to_texts(snapshot: Snapshot, actor: str) -> Change | None:
    """The change that turns every scalar string of maps and lists into a text of the same content."""
    t = Transaction(snapshot, actor)
    for (obj, reg), slot in list(snapshot.registers.items()):
        if slot and slot[-1].tag == "str" and slot[-1].action == 1 and snapshot.type_of(obj) in ("map", "list"):
            prop = reg if isinstance(reg, str) else snapshot.elements(obj).index(reg)
            text = slot[-1].value
            t.splice_text(t.put_object(obj, prop, "text"), 0, 0, text)
    return t.commit()
