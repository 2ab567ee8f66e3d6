"""Aggregates taken before a join that would multiply rows.

Rows that are alike in every column a statement still needs become one row with their number
(the weight) and partial aggregates.  A join of two folded sides multiplies weights and sums
instead of rows, so a hot key (NULL too) costs what its distinct rows cost.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import FLOATING, require_ordered, require_summable
from .predicates import Value

Aggregates = Sequence[tuple[str, "Value | None"]]
WHOLE = "decimal(38,0)"


@dataclass
class Folded:
    """A frame, the column that says how many rows each row stands for, and the aggregates it has parts of."""

    frame: DataFrame
    weight: str | None = None
    parts: set[int] = field(default_factory=set)


def check(aggregates: Aggregates) -> None:
    for function, value in aggregates:
        if value is not None and function in ("sum", "avg"):
            require_summable(value.kind, function)
        elif value is not None and function != "count":
            require_ordered(value.kind, function.upper())


def _kind(value: Value) -> str:
    return "double" if isinstance(value.kind, FLOATING) else WHOLE


def _times(number: Column, weight: str | None, kind: str) -> Column:
    """Integral sums are exact decimals until the end: only a result that is no long overflows."""
    if weight is None:
        return number.cast(kind)
    return (number.cast("decimal(20,0)" if kind == WHOLE else kind) * F.col(weight).cast("decimal(19,0)" if kind == WHOLE else kind)).cast(kind)


def fold(side: Folded, names: Sequence[str], aggregates: Aggregates, weight: str) -> Folded:
    """One row for each distinct combination of the columns ``names``."""
    has, out, parts = set(side.frame.columns), [], set(side.parts)
    out.append((F.count(F.lit(1)) if side.weight is None else F.coalesce(F.sum(side.weight), F.lit(0))).alias(weight))
    for i, (function, value) in enumerate(aggregates):
        if i in side.parts:
            sums = {"s": F.sum(f"p{i}s"), "n": F.coalesce(F.sum(f"p{i}n"), F.lit(0)), "m": (F.min if function == "min" else F.max)(f"p{i}m")}
        elif value is not None and value.name in has:
            one = F.lit(1).cast("long") if side.weight is None else F.col(side.weight)
            sums = {
                "s": F.sum(_times(value.column, side.weight, _kind(value))) if function in ("sum", "avg") else None,
                "n": F.coalesce(F.sum(F.when(value.column.isNotNull(), one)), F.lit(0)),
                "m": (F.min if function == "min" else F.max)(value.column) if function in ("min", "max") else None,
            }
        else:
            continue
        parts.add(i)
        for part in _parts(function):
            column = sums[part]
            out.append((column.cast(_kind(value)) if part == "s" else column).alias(f"p{i}{part}"))
    return Folded(side.frame.groupBy(*names).agg(*out), weight, parts)


def _parts(function: str) -> str:
    return {"count": "n", "sum": "s", "avg": "sn"}.get(function, "m")


def multiplied(joined: DataFrame, left: Folded, right: Folded, aggregates: Aggregates) -> Folded:
    """The rows of two folded sides after their join: each side's parts count as often as the other side's rows."""
    weight, out = left.weight, []
    for name in joined.columns:
        if name in (left.weight, right.weight):
            continue
        i = int(name[1:-1]) if name[0] == "p" else None
        if i is None or name[-1] == "m":
            out.append(F.col(name))
            continue
        other = right.weight if i in left.parts else left.weight
        out.append((F.col(name) * F.col(other) if name[-1] == "n" else _whole(F.col(name), other, _kind(aggregates[i][1]))).alias(name))
    out.append((F.col(left.weight) * F.col(right.weight)).alias(weight))
    return Folded(joined.select(*out), weight, left.parts | right.parts)


def _whole(part: Column, weight: str, kind: str) -> Column:
    return (part * F.col(weight).cast("decimal(19,0)" if kind == WHOLE else kind)).cast(kind)


def finished(aggregates: Aggregates, weight: str) -> list[Column]:
    """The aggregates from the parts of a last fold."""
    out = []
    for i, (function, value) in enumerate(aggregates):
        if value is None:
            out.append(F.col(weight))
        elif function == "count":
            out.append(F.col(f"p{i}n"))
        elif function == "sum":
            out.append(F.col(f"p{i}s").cast("double" if _kind(value) == "double" else "long"))
        elif function == "avg":
            out.append(F.when(F.col(f"p{i}n") > 0, F.col(f"p{i}s").cast("double") / F.col(f"p{i}n")))
        else:
            out.append(F.col(f"p{i}m"))
    return out
