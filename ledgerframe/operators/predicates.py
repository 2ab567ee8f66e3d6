"""Comparisons with two-valued logic.

``=`` is null-safe and false across families, ``!=`` is its exact negation, and an ordering
comparison with a NULL is false.  The forms chosen here keep what Parquet can use: a column
equal to a non-null constant stays a plain ``==``, which in a WHERE clause (there is no NOT)
means the same as the null-safe form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.families import ORDERED, family


@dataclass(frozen=True)
class Value:
    """A bound operand: its column, type, whether it is a constant or never null, and a column's inner name."""

    column: Column
    kind: T.DataType
    constant: bool = False
    required: bool = False
    name: str | None = None

    @property
    def null(self) -> bool:
        return isinstance(self.kind, T.NullType)


def equal(a: Value, b: Value) -> Column:
    if a.null or b.null:
        if a.null and b.null:
            return F.lit(True)
        return (b if a.null else a).column.isNull()
    if family(a.kind) != family(b.kind):
        if a.constant or b.constant or a.required or b.required:
            return F.lit(False)
        return a.column.isNull() & b.column.isNull()
    _require_equatable(a, b)
    if a.constant or b.constant or a.required or b.required:
        return a.column == b.column
    return a.column.eqNullSafe(b.column)


def not_equal(a: Value, b: Value) -> Column:
    if a.null or b.null:
        if a.null and b.null:
            return F.lit(False)
        return (b if a.null else a).column.isNotNull()
    if family(a.kind) != family(b.kind):
        if a.constant or b.constant or a.required or b.required:
            return F.lit(True)
        return ~(a.column.isNull() & b.column.isNull())
    _require_equatable(a, b)
    return ~a.column.eqNullSafe(b.column)


def ordered(a: Value, op: str, b: Value) -> Column:
    if a.null or b.null:
        return F.lit(False)
    kinds = family(a.kind), family(b.kind)
    if kinds[0] != kinds[1] or kinds[0] not in ORDERED:
        raise ValueError(f"Cannot compare {a.kind.simpleString()} with {b.kind.simpleString()}")
    x, y = a.column, b.column
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def compare(a: Value, op: str, b: Value) -> Column:
    if op == "=":
        return equal(a, b)
    return not_equal(a, b) if op == "!=" else ordered(a, op, b)


def _require_equatable(a: Value, b: Value) -> None:
    for v in (a, b):
        if isinstance(v.kind, T.MapType):
            raise ValueError("Maps cannot be compared")
