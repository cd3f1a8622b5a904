"""Partition transforms: identity, year, month, day, hour, bucket[N], truncate[W], void."""

from __future__ import annotations

import datetime as dt
import re
import struct
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _mix(k: int) -> int:
    k = k * 0xCC9E2D51 & 0xFFFFFFFF
    k = (k << 15 | k >> 17) & 0xFFFFFFFF
    return k * 0x1B873593 & 0xFFFFFFFF


def murmur3(data: bytes) -> int:
    """32-bit Murmur3 (x86 variant) with seed 0, signed."""
    h, body = 0, len(data) // 4 * 4
    for i in range(0, body, 4):
        h ^= _mix(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if tail := data[body:]:
        h ^= _mix(int.from_bytes(tail, "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur3_many(values: list[bytes]) -> np.ndarray:
    """``murmur3`` of many values at once: those of one length are hashed together, word by word."""
    out = np.zeros(len(values), np.int32)
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    rotate = lambda x, by: (x << np.uint32(by)) | (x >> np.uint32(32 - by))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        padded = -(-size // 4) * 4
        raw = np.zeros((len(at), padded), np.uint8)
        if size:
            raw[:, :size] = np.frombuffer(b"".join(values[i] for i in at.tolist()), np.uint8).reshape(len(at), size)
        k = raw.view("<u4").astype(np.uint32)
        k = rotate(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = np.zeros(len(at), np.uint32)
        for w in range(size // 4):
            h = rotate(h ^ k[:, w], 13) * np.uint32(5) + np.uint32(0xE6546B64)
        if size % 4:
            h ^= k[:, -1]
        h ^= np.uint32(size & 0xFFFFFFFF)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        out[at] = (h ^ (h >> np.uint32(16))).view(np.int32)
    return out


@F.pandas_udf(T.IntegerType())
def _hash_text(values: pd.Series) -> pd.Series:
    known = values.notna()
    out = pd.Series(pd.NA, index=values.index, dtype="Int32")
    if known.any():
        out[known] = murmur3_many([x.encode() if isinstance(x, str) else bytes(x) for x in values[known]])
    return out


_M32 = 0xFFFFFFFF


def _bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c`` with ``c`` computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _rotate(c: Column, by: int) -> Column:
    return _bind(c, lambda x: F.shiftleft(x, by).bitwiseAND(F.lit(_M32)).bitwiseOR(F.shiftrightunsigned(x, 32 - by)))


def _times(c: Column, factor: int) -> Column:
    """Product modulo 2**32 of an unsigned 32-bit value held in a bigint, in halves so that it never overflows."""
    return _bind(
        c,
        lambda x: (
            x.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor) + F.shiftleft(
                (F.shiftrightunsigned(x, 16) * F.lit(factor)).bitwiseAND(F.lit(0xFFFF)), 16
            )
        ).bitwiseAND(F.lit(_M32))
    )


def _shifted(c: Column, by: int) -> Column:
    return _bind(c, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, by)))


def hash_long(c: Column) -> Column:
    """``murmur3`` of a number's eight little-endian bytes, in JVM expressions only."""
    v = c.cast("bigint")
    h = F.lit(0).cast("bigint")
    for part in (v.bitwiseAND(F.lit(_M32)), F.shiftrightunsigned(v, 32)):
        k = _times(_rotate(_times(part, 0xCC9E2D51), 15), 0x1B873593)
        h = (_rotate(h.bitwiseXOR(k), 13) * 5 + F.lit(0xE6546B64)).bitwiseAND(F.lit(_M32))
    h = h.bitwiseXOR(F.lit(8).cast("bigint"))
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = _times(_shifted(h, shift), factor)
    return _bind(_shifted(h, 16), lambda x: F.when(x >= F.lit(1 << 31), x - F.lit(1 << 32)).otherwise(x).cast("int"))


def bucket(n: int, c: Column, kind: str = "long") -> Column:
    """Bucket number. ``kind``: long (all whole numbers, dates as days, timestamps as microseconds) or text (strings and
    binary)."""
    h = hash_long(c) if kind == "long" else _hash_text(c)
    return F.pmod(h.bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n)).cast("int")


def truncate_int(w: int, c: Column) -> Column:
    return c - F.pmod(c, F.lit(w))


def truncate_text(w: int, c: Column) -> Column:
    return F.substring(c, 1, w)


def years(c: Column) -> Column:
    return (F.year(c) - 1970).cast("int")


def months(c: Column) -> Column:
    return ((F.year(c) - 1970) * 12 + F.month(c) - 1).cast("int")


def days(c: Column) -> Column:
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))


def hours(c: Column) -> Column:
    return (days(c) * 24 + F.hour(c)).cast("int")


_SIMPLE: dict[str, Callable[[Column], Column]] = {
    "identity": lambda c: c, "year": years, "month": months, "day": days, "hour": hours, "void": lambda c: F.lit(None)
}


def transform(name: str, c: Column, kind: str | None = None) -> Column:
    """The transform called ``name`` (as in a partition spec) of ``c``. ``kind``: int or text, for bucket and truncate
    (int if not given)."""
    if name in _SIMPLE:
        return _SIMPLE[name](c)
    m = re.fullmatch(r"(bucket|truncate)\[(\d+)\]", name)
    if not m:
        raise ValueError(f"no transform: {name!r}")
    n, text = int(m[2]), kind == "text"
    if m[1] == "bucket":
        return bucket(n, c, "text" if text else "long")
    return truncate_text(n, c) if text else truncate_int(n, c)


# The same for single values, for pruning by partitions

EPOCH = dt.datetime(1970, 1, 1)


def physical(kind: str) -> str | None:
    """How values of a logical type are kept in partitions: int, long, float, double, boolean or string; None for those
    without bounds."""
    if kind in ("date", "int"):
        return "int"
    if kind in ("long", "time") or kind.startswith("timestamp"):
        return "long"
    return kind if kind in ("float", "double", "boolean", "string") else "string" if kind == "uuid" else None


def result_kind(name: str, kind: str) -> str | None:
    """``physical`` of what the transform called ``name`` makes of a ``kind``."""
    return physical(kind) if name == "identity" or name.startswith("truncate") else None if name == "void" else "int"


def physical_value(kind: str, v: Any) -> Any:
    """A literal as it is kept in partitions: dates as days, times as microseconds."""
    if kind == "date":
        v = dt.date.fromisoformat(v) if isinstance(v, str) else v
        return (
            v.date() if isinstance(v, dt.datetime) else v
        ).toordinal() - EPOCH.date().toordinal() if isinstance(v, dt.date) else v
    if kind in ("timestamp", "timestamptz"):
        v = dt.datetime.fromisoformat(v) if isinstance(v, str) else v
        if isinstance(v, dt.datetime):
            v = (v.astimezone(dt.UTC) if v.tzinfo else v).replace(tzinfo=None)
            return (v - EPOCH) // dt.timedelta(microseconds=1)
    return str(v) if kind == "uuid" else v


def physical_column(kind: str, c: Column) -> Column:
    """``physical_value`` of a column."""
    if kind == "date":
        return F.datediff(c, F.lit("1970-01-01").cast("date"))
    if kind == "timestamptz":
        return F.unix_micros(c)
    if kind == "timestamp":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    return c


def in_utc(kind: str, c: Column) -> Column:
    """An instant as its time of day in UTC, by which the format reckons years to hours, whatever the session's zone; other columns as they are."""
    if kind != "timestamptz":
        return c
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01").cast("timestamp_ntz"))


def apply_value(name: str, kind: str, v: Any) -> Any:
    """The transform called ``name`` of one value of a ``kind``, as it is kept in partitions. TypeError where it can't
    be told."""
    if v is None:
        return None
    v = physical_value(kind, v)
    if name == "identity":
        return v
    if name in ("year", "month", "day", "hour"):
        if not isinstance(v, int):
            raise TypeError(name)
        at = EPOCH + (dt.timedelta(days=v) if kind == "date" else dt.timedelta(microseconds=v))
        return {
            "year": at.year - 1970, "month": (at.year - 1970) * 12 + at.month - 1, "day": (at - EPOCH).days,
            "hour": (at - EPOCH) // dt.timedelta(hours=1)
        }[name]
    m = re.fullmatch(r"(bucket|truncate)\[(\d+)\]", name)
    if not m:
        raise TypeError(name)
    n = int(m[2])
    if m[1] == "truncate":
        return v[:n] if isinstance(v, str) else v - v % n
    if isinstance(v, bool) or not isinstance(v, (int, str, bytes)):
        raise TypeError(name)
    data = struct.pack("<q", v) if isinstance(v, int) else v.encode() if isinstance(v, str) else v
    return (murmur3(data) & 0x7FFFFFFF) % n
