"""The column encodings of the binary format: runs, deltas, booleans, tagged values."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable
from itertools import groupby

from .leb128 import read_sleb, read_uleb, sleb, uleb

# Type codes of the format's columns and scalars.
GROUP, ACTOR, INTEGER, DELTA, BOOLEAN, STRING, VALUE_META, VALUE = range(8)
TAGS = {"null": 0, "false": 1, "true": 2, "uint": 3, "int": 4, "f64": 5, "str": 6, "bytes": 7, "counter": 8, "timestamp": 9}

_NAMES = {code: tag for tag, code in TAGS.items()}


def _text(s: str) -> bytes:
    raw = s.encode()
    return uleb(len(raw)) + raw


def _read_text(data: bytes, at: int) -> tuple[str, int]:
    n, at = read_uleb(data, at)
    if at + n > len(data):
        raise ValueError("a string is cut short")
    return data[at : at + n].decode(), at + n


def write_runs(values: Iterable, put: Callable[[object], bytes]) -> bytes:
    """Repeats as (count, value), singles as (-count, values), nulls as (0, count); nothing at all if all are null."""
    runs = [(v, len(list(same))) for v, same in groupby(values)]
    if not runs or len(runs) == 1 and runs[0][0] is None:
        return b""
    out = bytearray()
    singles: list = []

    def flush() -> None:
        if singles:
            out.extend(sleb(-len(singles)))
            out.extend(b"".join(map(put, singles)))
            singles.clear()

    for v, n in runs:
        if v is not None and n == 1:
            singles.append(v)
            continue
        flush()
        out.extend(sleb(0) + uleb(n) if v is None else sleb(n) + put(v))
    flush()
    return bytes(out)


def read_runs(data: bytes, get: Callable[[bytes, int], tuple[object, int]]) -> list:
    out: list = []
    at = 0
    while at < len(data):
        n, at = read_sleb(data, at)
        if n > 0:
            v, at = get(data, at)
            out += [v] * n
        elif n < 0:
            for _ in range(-n):
                v, at = get(data, at)
                out.append(v)
        else:
            n, at = read_uleb(data, at)
            out += [None] * n
    return out


def write_column(kind: int, values: list) -> bytes:
    if kind == BOOLEAN:
        out, now = bytearray(), False
        for v, same in groupby(bool(x) for x in values):
            if v != now:
                out += uleb(0)
            out += uleb(sum(1 for _ in same))
            now = not v
        return bytes(out) if any(values) else b""
    if kind == DELTA:
        last, steps = 0, []
        for v in values:
            steps.append(None if v is None else v - last)
            last = last if v is None else v
        return write_runs(steps, sleb)
    return write_runs(values, _text if kind == STRING else uleb)


def read_column(kind: int, data: bytes) -> list:
    if kind == BOOLEAN:
        out: list = []
        at, now = 0, False
        while at < len(data):
            n, at = read_uleb(data, at)
            out += [now] * n
            now = not now
        return out
    if kind == DELTA:
        out, last = [], 0
        for step in read_runs(data, read_sleb):
            last = last if step is None else last + step
            out.append(None if step is None else last)
        return out
    return read_runs(data, _read_text if kind == STRING else read_uleb)


def write_value(tag: str | None, v) -> tuple[int, bytes]:
    """(meta word, bytes) of a scalar: the meta word is its length times 16 plus its type."""
    if tag in (None, "null"):
        return 0, b""
    if tag == "bool":
        return TAGS["true" if v else "false"], b""
    if tag.startswith("unknown"):
        return len(v) << 4 | int(tag[7:]), bytes(v)
    raw = {
        "uint": lambda: uleb(int(v)), "f64": lambda: struct.pack("<d", v), "str": lambda: v.encode(), "bytes": lambda: bytes(v),
    }.get(tag, lambda: sleb(int(v)))()
    return len(raw) << 4 | TAGS[tag], raw


def read_value(meta: int, raw: bytes) -> tuple[str, object]:
    """(tag, value) of a scalar."""
    tag = _NAMES.get(meta & 15)
    if tag is None:
        return f"unknown{meta & 15}", raw
    if tag in ("true", "false"):
        return "bool", tag == "true"
    if tag == "null":
        return tag, None
    if tag == "uint":
        return tag, read_uleb(raw, 0)[0]
    if tag == "f64":
        return tag, struct.unpack("<d", raw)[0]
    if tag == "str":
        return tag, raw.decode()
    if tag == "bytes":
        return tag, raw
    return tag, read_sleb(raw, 0)[0]
