"""Rows as JSON text."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame


def _plain(value: object) -> object:
    """Numbers, booleans, strings and nulls as they are; everything else quoted, NaN too."""
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else str(value)


def as_json(value: object) -> str:
    return json.dumps(_plain(value), ensure_ascii=False, separators=(",", ":"))


def listed_json(rows: Iterable[Mapping[str, object]]) -> Iterator[str]:
    """``{"rows":[...]}`` in parts, one for each row."""
    yield '{"rows":['
    for i, row in enumerate(rows):
        yield ("," if i else "") + as_json(row)
    yield "]}"


def rows_json(df: DataFrame) -> Iterator[str]:
    """:func:`listed_json` of all rows, a partition of rows at a time on the driver."""
    return listed_json(row.asDict(recursive=True) for row in df.toLocalIterator())


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, written by the executors; nulls are kept."""
    df.write.option("ignoreNullFields", "false").json(path)
