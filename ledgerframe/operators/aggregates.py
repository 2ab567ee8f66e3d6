"""COUNT, SUM, AVG, MIN and MAX, with and without groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.families import FLOATING, require_ordered, require_summable
from .predicates import Value


def aggregate_of(function: str, value: Value | None) -> Column:
    """The aggregate of a column; NULLs are left out and an empty input gives NULL (COUNT: 0).

    Integral sums are longs and fail on overflow (which needs ANSI mode, Spark's default);
    sums of floats and all averages are doubles.
    """
    if value is None:
        return F.count(F.lit(1))
    if function == "count":
        return F.count(value.column)
    if function in ("sum", "avg"):
        require_summable(value.kind, function)
        number = value.column.cast("double" if isinstance(value.kind, FLOATING) else "long")
        return F.sum(number) if function == "sum" else F.avg(number)
    require_ordered(value.kind, function.upper())
    return F.min(value.column) if function == "min" else F.max(value.column)


def require_groupable(key: Value) -> None:
    if isinstance(key.kind, T.MapType):
        raise ValueError("Maps cannot be grouped")


def grouped(df: DataFrame, keys: Sequence[Value], aggregates: Sequence[Column]) -> DataFrame:
    """One row per distinct key (NULLs are equal), or one row in all without keys."""
    for key in keys:
        require_groupable(key)
    columns = [key.column for key in keys]
    if not aggregates:
        return df.select(*columns).distinct()
    return df.groupBy(*columns).agg(*aggregates) if columns else df.agg(*aggregates)
