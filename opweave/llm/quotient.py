"""Quotient filters as compact bytes, built and probed with whole-array operations.

A filter of geometry (q, r) stores fingerprints of q + r bits.  The high q bits of a fingerprint
(its quotient) name a home slot, the low r bits (its remainder) are what is stored.  Fingerprints
lie in sorted order; three bits a slot tell where runs are: *occupied* (some fingerprint has this
home), *continuation* (the slot continues the run of the slot before) and *shifted* (the stored
remainder isn't in its home slot).  Slots past the last home take what is shifted beyond it.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<BBQQ"  # q, r, number of fingerprints, number of slots


def encode(fps: np.ndarray, q: int, r: int) -> bytes:
    """The filter that holds ``fps`` (any order, repeats allowed)."""
    return _pack(np.unique(np.asarray(fps, dtype=np.int64)), q, r)


def _pack(fps: np.ndarray, q: int, r: int) -> bytes:
    """The filter of ascending, distinct fingerprints."""
    n = len(fps)
    home = fps >> r
    steps = np.arange(n, dtype=np.int64)
    pos = np.maximum.accumulate(home - steps) + steps if n else home
    slots = max(1 << q, int(pos[-1]) + 1 if n else 0)
    occupied, continuation, shifted = (np.zeros(slots, dtype=bool) for _ in range(3))
    occupied[home] = True
    continuation[pos[1:][home[1:] == home[:-1]]] = True
    shifted[pos[pos != home]] = True
    width = (r + 7) // 8
    stored = np.zeros((slots, width), dtype=np.uint8)
    rem = fps & ((1 << r) - 1)
    for k in range(width):
        stored[pos, k] = (rem >> (8 * k)) & 0xFF
    return b"".join(
        [struct.pack(_HEAD, q, r, n, slots), *(np.packbits(b).tobytes() for b in (occupied, continuation, shifted)), stored.tobytes()]
    )


def _open(payload: bytes):
    q, r, n, slots = struct.unpack_from(_HEAD, payload)
    at, bits = struct.calcsize(_HEAD), (slots + 7) // 8
    flags = []
    for _ in range(3):
        flags.append(np.unpackbits(np.frombuffer(payload, np.uint8, bits, at), count=slots).astype(bool))
        at += bits
    width = (r + 7) // 8
    stored = np.frombuffer(payload, np.uint8, slots * width, at).reshape(slots, width)
    return q, r, n, slots, *flags, stored


def _remainders(stored: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.int64)
    for k in range(stored.shape[1]):
        out |= stored[at, k].astype(np.int64) << (8 * k)
    return out


def size(payload: bytes) -> int:
    """How many fingerprints the filter holds."""
    return struct.unpack_from(_HEAD, payload)[2]


def decode(payload: bytes) -> np.ndarray:
    """The fingerprints of a filter, in ascending order."""
    q, r, n, slots, occupied, continuation, shifted, stored = _open(payload)
    at = np.flatnonzero(occupied | continuation | shifted)
    homes = np.flatnonzero(occupied)
    run = np.cumsum(~continuation[at]) - 1
    return (homes[run] << r) | _remainders(stored, at) if len(at) else np.zeros(0, np.int64)


def merge(a: bytes, b: bytes) -> bytes:
    """The filter of all fingerprints of two filters of the same geometry, by merging their two sorted runs."""
    (q, r), other = struct.unpack_from(_HEAD, a)[:2], struct.unpack_from(_HEAD, b)[:2]
    if (q, r) != other:
        raise ValueError(f"filters of different geometry: {(q, r)} and {other}")
    x, y = decode(a), decode(b)
    at = np.searchsorted(x, y)
    if len(x):
        fresh = x[np.minimum(at, len(x) - 1)] != y
        y, at = y[fresh], at[fresh]
    out = np.empty(len(x) + len(y), dtype=np.int64)
    places = at + np.arange(len(y))
    mine = np.ones(len(out), dtype=bool)
    mine[places] = False
    out[places], out[mine] = y, x
    return _pack(out, q, r)


def probe(payload: bytes, fps: np.ndarray) -> np.ndarray:
    """For each fingerprint whether the filter holds it; touches only the home slot and its run."""
    q, r, n, slots, occupied, continuation, shifted, stored = _open(payload)
    fps = np.asarray(fps, dtype=np.int64)
    hit = np.zeros(len(fps), dtype=bool)
    home = fps >> r
    maybe = np.flatnonzero(occupied[home])
    if not len(maybe):
        return hit
    starts = np.flatnonzero((occupied | continuation | shifted) & ~continuation)
    ends = np.append(np.flatnonzero(~continuation), slots)
    rank = np.cumsum(occupied) - 1
    start = starts[rank[home[maybe]]]
    end = ends[np.searchsorted(ends, start, side="right")]
    want = fps[maybe] & ((1 << r) - 1)
    while len(maybe):
        hit[maybe[_remainders(stored, start) == want]] = True
        start = start + 1
        on = (start < end) & ~hit[maybe]
        maybe, start, end, want = maybe[on], start[on], end[on], want[on]
    return hit
