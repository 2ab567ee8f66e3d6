"""Registered tables: a DataFrame, its key and its computed columns."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from ..store import RecordStore

KEY = "_key"
Columns = Iterable[Union[str, tuple[str, Column]]]


@dataclass
class Table:
    """Rows with the columns of the table (and ``_key``, if it has one) in schema order."""

    name: str
    frame: DataFrame
    has_key: bool
    columns: tuple[str, ...]
    store: RecordStore | None = None
    indexes: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.kinds: dict[str, T.DataType] = {f.name: f.dataType for f in self.frame.schema.fields}
        self.by_name = {c.lower(): c for c in self.columns}
        if self.has_key:
            self.by_name[KEY] = KEY

    def column(self, name: str) -> str:
        found = self.by_name.get(name.lower())
        if found is None:
            raise ValueError(f"Unknown column: {self.name}.{name}")
        return found


class Catalog:
    """Tables by name, ignoring case; adding a name again replaces the table."""

    def __init__(self) -> None:
        self._tables: dict[str, Table] = {}
        self._chosen: dict[str, list | None] = {}

    def add(self, name: str, df: DataFrame, key: str | Column | None = None, columns: Columns | None = None) -> Catalog:
        """Register ``df``.

        ``key`` names the column (or is the expression) that is ``_key``: unique and never
        null.  ``columns`` are names of ``df`` or (name, expression) pairs; by default all
        columns.  Of columns with equal names (case ignored) the last one counts.
        """
        self._tables[name.lower()] = _table(name, df, key, columns)
        return self

    def add_shards(self, name: str, shards: Sequence[DataFrame], key: str | None = None, columns: Columns | None = None) -> Catalog:
        """Register the union of equally named columns of all ``shards``; types are widened."""
        if not shards:
            raise ValueError("At least one shard is required")
        kept = list(columns) if columns is not None else None
        return self.add(name, functools.reduce(DataFrame.unionByName, shards), key, kept)

    def add_store(self, name: str, store: RecordStore, columns: Columns | None = None) -> Catalog:
        """Register the current records of a store; each query sees the newest version."""
        self._chosen[name.lower()] = None if columns is None else list(columns)
        self._tables[name.lower()] = self._of_store(name, store)
        return self

    def _of_store(self, name: str, store: RecordStore) -> Table:
        df, chosen = store.current(), self._chosen[name.lower()]
        table = _table(name, df, KEY, [c for c in df.columns if c != KEY] if chosen is None else chosen)
        table.store = store
        return table

    def index(self, table: str, column: str) -> Catalog:
        """Declare that a column of a store is looked up: compaction then sorts files by it.

        The column must exist in the store's schema and must not be the key.
        """
        found = self.table(table)
        if column.lower() == KEY:
            raise ValueError("The key needs no index")
        name = found.column(column)
        if found.store is None:
            raise ValueError("Only tables of a store can be indexed")
        found.store.sort_by(name)
        found.indexes.add(name)
        return self

    def table(self, name: str) -> Table:
        found = self._tables.get(name.lower())
        if found is None:
            raise ValueError(f"Unknown table: {name}")
        if found.store is not None:
            fresh = self._of_store(found.name, found.store)
            fresh.indexes = found.indexes
            return fresh
        return found

    def names(self) -> list[str]:
        return sorted(t.name for t in self._tables.values())


def _table(name: str, df: DataFrame, key: str | Column | None, columns: Columns | None) -> Table:
    wanted: dict[str, tuple[str, Column]] = {}
    for c in df.columns if columns is None else columns:
        label, column = (c, F.col(f"`{c}`")) if isinstance(c, str) else c
        if label.lower() == KEY:
            continue
        wanted[label.lower()] = (label, column)
    select = [column.alias(label) for label, column in wanted.values()]
    if key is not None:
        select.insert(0, (F.col(f"`{key}`") if isinstance(key, str) else key).alias(KEY))
    return Table(name, df.select(*select), key is not None, tuple(label for label, _ in wanted.values()))
