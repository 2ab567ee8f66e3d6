"""Sorting with NULL as the greatest value, and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_key(column: Column, descending: bool) -> Column:
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def ordered_rows(df: DataFrame, keys: Sequence[tuple[str, bool]], limit: int | None) -> DataFrame:
    """Sorted and cut rows; with both, Spark keeps only the first ``limit`` rows of each task."""
    if keys:
        df = df.orderBy(*[sort_key(F.col(f"`{name}`"), descending) for name, descending in keys])
    return df if limit is None else df.limit(limit)
