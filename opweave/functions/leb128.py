"""Variable-length integers: seven bits a byte, the lowest first."""

from __future__ import annotations


_BYTES = [bytes([b]) for b in range(0x80)]


def uleb(n: int) -> bytes:
    if 0 <= n < 0x80:
        return _BYTES[n]
    if n < 0:
        raise ValueError("negative")
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def sleb(n: int) -> bytes:
    if -64 <= n < 64:
        return _BYTES[n & 0x7F]
    out = bytearray()
    while not -64 <= n < 64:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n & 0x7F)
    return bytes(out)


def read_uleb(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position)."""
    if at < len(data) and data[at] < 0x80:
        return data[at], at + 1
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("a number is cut short")
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            break
    if n >= 1 << 64 or (b == 0 and shift > 7):
        raise ValueError("a number is too large or padded")
    return n, at


def read_sleb(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position)."""
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("a number is cut short")
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            break
    if b & 0x40:
        n -= 1 << shift
    if not -(1 << 63) <= n < 1 << 63:
        raise ValueError("a number is too large")
    return n, at
