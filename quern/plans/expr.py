"""Portable predicates: the filter algebra of table scans as objects, as JSON and as Columns.

Comparisons follow two-valued logic: a comparison with null is false, its negation true; ``eq`` of two nulls is true. In
the positive part of a filter the bare comparison is emitted, which Parquet can push down (null and false drop a row
alike); below ``not`` and in projections it is completed to a boolean.
"""

from __future__ import annotations

import datetime as dt
import decimal
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.transforms import transform

_COMPARE = {"lt": "__lt__", "lt-eq": "__le__", "gt": "__gt__", "gt-eq": "__ge__", "eq": "__eq__", "not-eq": "__ne__"}
UNARY = ("is-null", "not-null", "is-nan", "not-nan")
SET = ("in", "not-in")
PREFIX = ("starts-with", "not-starts-with")


@dataclass(frozen=True)
class Term:
    """A column by its dotted name, or a transform of one."""

    name: str
    transform: str | None = None

    def column(self) -> Column:
        c = F.col(self.name)
        return transform(self.transform, c) if self.transform else c

    def to_json(self) -> Any:
        return {"type": "transform", "transform": self.transform, "term": self.name} if self.transform else self.name

    @staticmethod
    def of(x: Any) -> Term:
        if isinstance(x, Term):
            return x
        if isinstance(x, str):
            return Term(x)
        if x.get("type") == "reference":
            return Term(x["term"] if "term" in x else x["name"])
        if x.get("type") == "transform":
            return Term(x["term"] if isinstance(x["term"], str) else x["term"]["term"], x["transform"])
        raise ValueError(f"no term: {x!r}")


@dataclass(frozen=True)
class Predicate:
    """``op`` with its operands: ``args`` are predicates for and, or, not; a term with its literals otherwise."""

    op: str
    args: tuple = field(default=())

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate("and", (self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate("or", (self, other))

    def __invert__(self) -> Predicate:
        return Predicate("not", (self,))

    def to_json(self) -> dict:
        if self.op in ("true", "false"):
            return {"type": self.op}
        if self.op in ("and", "or"):
            return {"type": self.op, "left": self.args[0].to_json(), "right": self.args[1].to_json()}
        if self.op == "not":
            return {"type": "not", "child": self.args[0].to_json()}
        out = {"type": self.op, "term": self.args[0].to_json()}
        if self.op in SET:
            return out | {"values": [_plain(v) for v in self.args[1]]}
        return out if self.op in UNARY else out | {"value": _plain(self.args[1])}

    def column(self) -> Column:
        """As a boolean that is never null: for projections, join conditions and below ``not``."""
        if self.op in ("true", "false"):
            return F.lit(self.op == "true")
        if self.op == "and":
            return self.args[0].column() & self.args[1].column()
        if self.op == "or":
            return self.args[0].column() | self.args[1].column()
        if self.op == "not":
            return ~self.args[0].column()
        return F.coalesce(self._bare(), F.lit(self._of_null()))

    def filter(self) -> Column:
        """As a filter condition: keeps the same rows as ``column`` and leaves comparisons bare where that is safe, so
        that they reach the scan."""
        if self.op == "and":
            return self.args[0].filter() & self.args[1].filter()
        if self.op == "or":
            return self.args[0].filter() | self.args[1].filter()
        if self.op in ("true", "false", "not") or self._of_null():
            return self.column()
        return self._bare()

    def _of_null(self) -> bool:
        """The value where the bare comparison is null."""
        return self.op in ("not-in", "not-eq", "not-starts-with", "not-nan")

    def _bare(self) -> Column:
        c = self.args[0].column()
        if self.op == "is-null":
            return c.isNull()
        if self.op == "not-null":
            return c.isNotNull()
        if self.op == "is-nan":
            return F.isnan(c)
        if self.op == "not-nan":
            return ~F.isnan(c)
        if self.op in SET:
            known = [F.lit(v) for v in self.args[1] if v is not None]
            hit = c.isin(*known) if known else F.lit(False)
            if any(v is None for v in self.args[1]):
                hit = c.isNull() | hit
            return ~hit if self.op == "not-in" else hit
        value = self.args[1]
        if self.op in PREFIX:
            hit = c.startswith(value)
            return ~hit if self.op == "not-starts-with" else hit
        if self.op == "eq":
            return c.eqNullSafe(F.lit(value))
        if self.op == "not-eq":
            return ~c.eqNullSafe(F.lit(value))
        return getattr(c, _COMPARE[self.op])(F.lit(value))


def _plain(v: Any) -> Any:
    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, (decimal.Decimal, uuid.UUID)):
        return str(v)
    return v.hex() if isinstance(v, (bytes, bytearray)) else v


def from_json(x: dict | bool) -> Predicate:
    if isinstance(x, bool):
        return TRUE if x else FALSE
    op = x["type"]
    if op in ("true", "false"):
        return Predicate(op)
    if op in ("and", "or"):
        return Predicate(op, (from_json(x["left"]), from_json(x["right"])))
    if op == "not":
        return Predicate(op, (from_json(x["child"]),))
    term = Term.of(x["term"])
    if op in UNARY:
        return Predicate(op, (term,))
    if op in SET:
        return Predicate(op, (term, tuple(x["values"])))
    if op in PREFIX or op in _COMPARE:
        return Predicate(op, (term, x["value"]))
    raise ValueError(f"no predicate: {op!r}")


TRUE, FALSE = Predicate("true"), Predicate("false")


def _binary(op: str):
    def make(term: Any, value: Any) -> Predicate:
        return Predicate(op, (Term.of(term), value))

    make.__name__ = op.replace("-", "_")
    return make


def _unary(op: str):
    def make(term: Any) -> Predicate:
        return Predicate(op, (Term.of(term),))

    make.__name__ = op.replace("-", "_")
    return make


lt, lt_eq, gt, gt_eq, eq, not_eq = map(_binary, ("lt", "lt-eq", "gt", "gt-eq", "eq", "not-eq"))
starts_with, not_starts_with = map(_binary, PREFIX)
is_null, not_null, is_nan, not_nan = map(_unary, UNARY)


def is_in(term: Any, values: Any) -> Predicate:
    return Predicate("in", (Term.of(term), tuple(values)))


def not_in(term: Any, values: Any) -> Predicate:
    return Predicate("not-in", (Term.of(term), tuple(values)))


# The same two-valued rules for Columns that aren't predicates.


def truth(c: Column) -> Column:
    """A condition whose null counts as false."""
    return F.coalesce(c, F.lit(False))


def negate(c: Column) -> Column:
    return ~truth(c)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def divide(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, b)


def wrap_add(a: Column, b: Column) -> Column:
    """32-bit sum that wraps around."""
    total = a.cast("bigint") + b.cast("bigint")
    return (F.pmod(total + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def join_text(*parts: Column) -> Column:
    """Concatenation in which null is the empty text."""
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
