"""Predicates and casts over scalar values (the tagged struct ``val``), and list functions over arrays of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERS = ("int", "uint", "f64", "counter", "timestamp")


def is_kind(val: Column, *tags: str) -> Column:
    """Whether a value has one of the types ``null bool uint int f64 str bytes counter timestamp``; null for no value."""
    return val["tag"].isin(*tags)


def is_number(val: Column) -> Column:
    return is_kind(val, *_NUMBERS)


def to_int(val: Column) -> Column:
    """Any number as a 64-bit integer (fractions cut off); null if it isn't one or doesn't fit."""
    return F.coalesce(
        val["i"], F.when(val["tag"] == "uint", val["u"].try_cast("bigint")), F.when(val["tag"] == "f64", val["d"].try_cast("bigint"))
    )


def to_uint(val: Column) -> Column:
    """Any number that isn't negative as DECIMAL(20,0), else null."""
    n = F.coalesce(val["u"], val["i"].cast("decimal(20,0)"), F.when(val["tag"] == "f64", val["d"].try_cast("decimal(20,0)")))
    return F.when(n >= 0, n)


def to_double(val: Column) -> Column:
    return F.coalesce(val["d"], val["i"].cast("double"), val["u"].cast("double"))


def to_bool(val: Column) -> Column:
    return val["flag"]


def to_str(val: Column) -> Column:
    return val["s"]


def to_bytes(val: Column) -> Column:
    return val["b"]


def to_timestamp(val: Column) -> Column:
    return F.when(val["tag"] == "timestamp", F.timestamp_millis(val["i"]))


def at(values: Column, index: int) -> Column:
    """The value at an index from 0, or from the end if negative; null outside."""
    return F.try_element_at(values, F.lit(index + 1 if index >= 0 else index))


def index_of(values: Column, value) -> Column:
    """The first index (from 0) of a value, -1 if it isn't there."""
    return F.coalesce(F.array_position(values, value), F.lit(0)) - 1


def last_index_of(values: Column, value) -> Column:
    back = F.array_position(F.reverse(values), value)
    return F.when(back > 0, F.size(values) - back).otherwise(-1)


def includes(values: Column, value) -> Column:
    return F.coalesce(F.array_contains(values, value), F.lit(False))


def slice_of(values: Column, start: int, end: int | None = None) -> Column:
    """Values from ``start`` up to ``end``, both counted from the end if negative."""
    n = F.size(values)
    a = F.least(F.lit(start), n) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n if end is None else F.least(F.lit(end), n) if end >= 0 else F.greatest(n + end, F.lit(0))
    return F.slice(values, a + 1, F.greatest(b - a, F.lit(0)))


def splice_of(values: Column, start: int, delete: int, *new) -> Column:
    return F.concat(slice_of(values, 0, start), F.array(*[F.lit(v) for v in new]) if new else F.slice(values, 1, 0), slice_of(values, start + delete))


def find(values: Column, test) -> Column:
    """The first value that passes, or null."""
    return at(F.filter(values, test), 0)


def find_index(values: Column, test) -> Column:
    return index_of(F.transform(values, test), F.lit(True))


def join(values: Column, by: str = ",") -> Column:
    return F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit(""))), by)
