"""Scalar functions by the names of the .NET members they stand for, as Column expressions. Positions count from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | int | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Text


def length(s: Column) -> Column:
    return F.length(s)


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16LE")) / 2).cast("int")


def substring(s: Column, start: int, count: int | None = None) -> Column:
    return F.substring(s, start + 1, (1 << 31) - 1 if count is None else count)


def index_of(s: Column, part: str) -> Column:
    """-1 if ``part`` is not in ``s``."""
    return F.instr(s, part) - 1


def char_at(s: Column, i: int) -> Column:
    return F.substring(s, i + 1, 1)


def contains(s: Column, part: Column | str) -> Column:
    return F.contains(s, _c(part))


def starts_with(s: Column, part: Column | str) -> Column:
    return F.startswith(s, _c(part))


def ends_with(s: Column, part: Column | str) -> Column:
    return F.endswith(s, _c(part))


to_upper, to_lower, trim, trim_start, trim_end = F.upper, F.lower, F.trim, F.ltrim, F.rtrim


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def split(s: Column, by: str) -> Column:
    """``by`` is plain text."""
    import re

    return F.split(s, re.escape(by), -1)


def concat(*parts: Column) -> Column:
    """Null is the empty text."""
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def pad_left(s: Column, width: int, fill: str = " ") -> Column:
    """Never shortens."""
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def pad_right(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, width, fill))


def is_null_or_empty(s: Column) -> Column:
    return s.isNull() | (s == "")


def is_match(s: Column, pattern: str) -> Column:
    return s.rlike(pattern)


def regex_replace(s: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(s, pattern, new)


# Numbers


def round_even(x: Column, digits: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(x, digits)


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


absolute, floor, ceiling, sqrt, power, exp, sign = F.abs, F.floor, F.ceil, F.sqrt, F.pow, F.exp, F.signum


def log(x: Column) -> Column:
    return F.ln(x)


def smaller(a: Column, b: Column) -> Column:
    """Null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def larger(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def modulo(a: Column, b: Column) -> Column:
    """Takes the sign of the dividend."""
    return a % b


# Dates and times

year, month, day, hour, minute, second, day_of_year, date = F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second, F.dayofyear, F.to_date


def day_of_week(t: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(t) - 1


def add_days(t: Column, n: int) -> Column:
    return t + F.make_dt_interval(F.lit(n))


def add_hours(t: Column, n: int) -> Column:
    return t + F.make_dt_interval(F.lit(0), F.lit(n))


def add_months(t: Column, n: int) -> Column:
    return t + F.make_ym_interval(F.lit(0), F.lit(n))


def add_years(t: Column, n: int) -> Column:
    return t + F.make_ym_interval(F.lit(n), F.lit(0))


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)


# Arrays


def count(a: Column) -> Column:
    """Null for null."""
    return F.size(a)


def any_of(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(a, lambda x: F.coalesce(test(x), F.lit(False)))


def all_of(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.forall(a, lambda x: F.coalesce(test(x), F.lit(False)))


def element_at(a: Column, i: int) -> Column:
    """An error beyond the end."""
    return F.element_at(a, i + 1)


def first_or_default(a: Column) -> Column:
    return F.get(a, F.lit(0))


def total(a: Column, kind: str = "bigint") -> Column:
    """Nulls skipped, empty gives 0."""
    return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: (s + F.coalesce(x, F.lit(0))).cast(kind))


array_contains, array_min, array_max, array_select, array_where, array_distinct, array_concat, array_order = F.array_contains, F.array_min, F.array_max, F.transform, F.filter, F.array_distinct, F.concat, F.array_sort


# Maps

map_keys, map_values, contains_key = F.map_keys, F.map_values, F.map_contains_key


def value_of(m: Column, key: Column | str | int) -> Column:
    """An error if the key isn't there."""
    there = F.map_contains_key(m, key)
    return F.when(there, F.try_element_at(m, _c(key))).otherwise(F.raise_error(F.lit("the key is not in the map")))


def try_value_of(m: Column, key: Column | str | int) -> Column:
    return F.try_element_at(m, _c(key))


# Conditions


def choose(test: Column, then: Column, other: Column) -> Column:
    """A null test counts as false."""
    return F.when(test, then).otherwise(other)


first_known = F.coalesce


def has_value(x: Column) -> Column:
    return x.isNotNull()
