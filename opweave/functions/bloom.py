"""Bloom filters of change hashes with a fixed wire layout."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

from .leb128 import read_uleb, uleb

# The filter's geometry is part of the wire format.
BITS_PER_ENTRY = 10
PROBES = 7


def _probes(hashes: list[bytes], bits: int, probes: int) -> np.ndarray:
    """A row of bit positions for each hash, by triple hashing of its first twelve bytes."""
    x, y, z = (np.array(c, dtype=np.int64) % bits for c in zip(*(struct.unpack_from("<III", h) for h in hashes)))
    out = [x]
    for _ in range(probes - 1):
        x = (x + y) % bits
        y = (y + z) % bits
        out.append(x)
    return np.stack(out, axis=1)


class BloomFilter:
    """About one wrong yes in a hundred, never a wrong no.  An empty filter holds nothing."""

    def __init__(self, entries: int = 0, bits_per_entry: int = BITS_PER_ENTRY, probes: int = PROBES, bits: bytes = b""):
        self.entries, self.bits_per_entry, self.probes = entries, bits_per_entry, probes
        size = (entries * bits_per_entry + 7) // 8
        self.bits = np.frombuffer(bits, np.uint8).copy() if bits else np.zeros(size, np.uint8)

    @classmethod
    def of(cls, hashes: Iterable[bytes]) -> BloomFilter:
        hashes = list(hashes)
        f = cls(len(hashes))
        if hashes:
            at = _probes(hashes, 8 * len(f.bits), f.probes).ravel()
            np.bitwise_or.at(f.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return f

    def contains(self, hashes: Iterable[bytes]) -> np.ndarray:
        hashes = list(hashes)
        if not self.entries or not hashes:
            return np.zeros(len(hashes), dtype=bool)
        at = _probes(hashes, 8 * len(self.bits), self.probes)
        return ((self.bits[at >> 3] >> (at & 7)) & 1).astype(bool).all(axis=1)

    def to_bytes(self) -> bytes:
        if not self.entries:
            return b""
        return uleb(self.entries) + uleb(self.bits_per_entry) + uleb(self.probes) + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomFilter:
        if not data:
            return cls()
        entries, at = read_uleb(data, 0)
        per, at = read_uleb(data, at)
        probes, at = read_uleb(data, at)
        size = (entries * per + 7) // 8
        if len(data) - at < size:
            raise ValueError("a filter is cut short")
        return cls(entries, per, probes, data[at : at + size])
