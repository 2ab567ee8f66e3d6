"""Statements as DataFrames.

The plan is declared - scan, filters, joins in text order, grouping or projection, order,
limit - and everything else is left to Catalyst: pushdown, pruning, join order and strategy.
Only a join that multiplies rows (no side's column is unique) is prepared here: the sides of
a grouped statement are folded before it, and rows that still multiply are dealt out by blocks.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import require_ordered
from ..operators.aggregates import aggregate_of, grouped, require_groupable
from ..operators.folding import Folded, check, finished, fold, multiplied
from ..operators.joins import dealt_join, inner_join
from ..operators.ordering import ordered_rows
from ..operators.predicates import Value
from ..sources.catalog import KEY, Catalog
from .binder import BoundSource, Scope
from .syntax import Aggregate, Field, Item, Join, Ref, Star, Statement

log = logging.getLogger(__name__)

Joins = Sequence[tuple[Value, Value]]
Where = Sequence[tuple[set[str], Column]]


def compile_statement(statement: Statement, catalog: Catalog, parameters: Mapping[str, object]) -> DataFrame:
    """The result of a statement; ``ValueError`` for unknown or ambiguous names, missing
    parameters and types that don't fit, whether or not there are rows."""
    scope = Scope(parameters)
    joins = _bound(statement, catalog, scope)
    where = scope.conjuncts(statement.where)
    df, labels = (_grouped if statement.grouped else _projected)(statement, scope, joins, where)
    # columns are o0, o1, ... until the end: labels may differ in case only
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keys = []
    for order in statement.orders:
        label = _order_label(statement.items, order.name)
        if label not in labels:
            log.warning("ORDER BY %s is no column of the result and does nothing", order.name)
            continue
        inner = f"o{labels.index(label)}"
        require_ordered(kinds[inner], "ORDER BY")
        keys.append((inner, order.descending))
    df = ordered_rows(df, keys, statement.limit)
    return df.select(*[F.col(f"o{i}").alias(label) for i, label in enumerate(labels)])


def _bound(statement: Statement, catalog: Catalog, scope: Scope) -> Joins:
    """The two columns of each ON, the earlier source's first; afterwards all sources are in the scope."""
    scope.add(BoundSource.of(0, statement.source, catalog.table(statement.source.table)))
    out = []
    for position, join in enumerate(statement.joins, 1):
        new = BoundSource.of(position, join.source, catalog.table(join.source.table))
        here, there = _sides(join)
        old = scope.column(there)
        scope.add(new)
        out.append((old, new.value(here.name)))
    return out


class _Filters:
    """Conditions that wait for the sources of their columns."""

    def __init__(self, where: Where):
        self.waiting = list(where)

    def take(self, df: DataFrame) -> DataFrame:
        ready = [c for names, c in self.waiting if names <= set(df.columns)]
        self.waiting = [(names, c) for names, c in self.waiting if not names <= set(df.columns)]
        for condition in ready:
            df = df.where(condition)
        return df


def _multiplying(scope: Scope, joins: Joins) -> list[bool]:
    """Which joins can give more rows than both their sides have: those with no unique column.

    A table's key is unique until a join repeats its rows.
    """
    key = lambda s: {s.value(KEY).name} if s.table.has_key else set()
    unique, out = key(scope.sources[0]), []
    for source, (old, new) in zip(scope.sources[1:], joins):
        kept = new.required
        out.append(old.name not in unique and not kept)
        unique = (unique if kept else set()) | (key(source) if old.name in unique else set())
    return out


def _joined(scope: Scope, joins: Joins, where: Where) -> DataFrame:
    filters = _Filters(where)
    df, *others = [filters.take(s.frame) for s in scope.sources]
    ids = [_identity(s) for s in scope.sources]
    for position, (other, (old, new), many) in enumerate(zip(others, joins, _multiplying(scope, joins)), 1):
        df = filters.take(dealt_join(df, other, old, new, sum(ids[:position], []), ids[position]) if many else inner_join(df, other, old, new))
    return df


def _identity(source: BoundSource) -> list[str]:
    """Columns that tell a source's rows apart: the key, or else all that can be hashed."""
    return [source.inner[KEY]] if source.table.has_key else [n for n, kind in source.frame.dtypes if "map<" not in kind]


def _folded(scope: Scope, joins: Joins, where: Where, groups: Sequence[Value], aggregates: Sequence[tuple[str, Value | None]]) -> DataFrame:
    """The groups with the parts of their aggregates; sides are folded before a join that multiplies rows."""
    filters = _Filters(where)
    first, *others = [Folded(filters.take(s.frame)) for s in scope.sources]
    out = first
    for position, (other, (old, new), many) in enumerate(zip(others, joins, _multiplying(scope, joins)), 1):
        if not many:
            out = Folded(filters.take(inner_join(out.frame, other.frame, old, new)), out.weight, out.parts)
            continue
        needed = {v.name for v in groups} | {v.name for pair in joins[position - 1 :] for v in pair} | {n for names, _ in filters.waiting for n in names}
        left, right = (fold(s, [c for c in s.frame.columns if c in needed], aggregates, w) for s, w in ((out, "w0"), (other, f"w{position}")))
        mine, theirs = ([c for c in side.frame.columns if c in needed] for side in (left, right))
        if len(mine) == 1 or len(theirs) == 1:  # nothing but the join's column, which is unique then
            joined = inner_join(left.frame, right.frame, old, new)
        else:
            joined = dealt_join(left.frame, right.frame, old, new, mine, theirs)
        out = multiplied(joined, left, right, aggregates)
        out.frame = filters.take(out.frame)
    return fold(out, list(dict.fromkeys(v.name for v in groups)), aggregates, "w0").frame


def _sides(join: Join) -> tuple[Ref, Ref]:
    """The joined source's column and the other one."""
    mine = [r.alias is not None and r.alias.lower() == join.source.alias.lower() for r in (join.left, join.right)]
    if mine[0] == mine[1]:
        raise ValueError(f"One side of ON must be a column of {join.source.alias}, the other one of an earlier source")
    return (join.left, join.right) if mine[0] else (join.right, join.left)


def _collapsed(columns: list[tuple[str, object]]) -> dict[str, object]:
    """Equal labels become one column: the first one's place, the last one's value."""
    out: dict[str, object] = {}
    for label, column in columns:
        out[label] = column
    return out


def _projected(statement: Statement, scope: Scope, joins: Joins, where: Where) -> tuple[DataFrame, list[str]]:
    columns: list[tuple[str, Value]] = []
    for item in statement.items:
        if isinstance(item, Star):
            columns += [c for s in scope.sources for c in s.wildcard()]
        else:
            columns.append((item.label, scope.column(item.ref)))
    kept = _collapsed(columns)
    df = _joined(scope, joins, where)
    return df.select(*[v.column.alias(f"o{i}") for i, v in enumerate(kept.values())]), list(kept)


def _grouped(statement: Statement, scope: Scope, joins: Joins, where: Where) -> tuple[DataFrame, list[str]]:
    keys = [scope.column(ref) for ref in statement.groups]
    named = [Value(k.column.alias(f"g{i}"), k.kind) for i, k in enumerate(keys)]
    outputs: list[tuple[str, str]] = []
    aggregates: list[tuple[str, Value | None]] = []
    for item in statement.items:
        if isinstance(item, Star):
            raise ValueError("* cannot be grouped")
        if isinstance(item, Aggregate):
            aggregates.append((item.function, None if item.ref is None else scope.column(item.ref)))
            check(aggregates[-1:])
            outputs.append((item.label, f"a{len(aggregates) - 1}"))
        else:
            fits = [i for i, ref in enumerate(statement.groups) if ref.fits(item.ref)]
            if not fits:
                raise ValueError(f"{item.ref} must be in GROUP BY")
            scope.column(statement.groups[fits[0]] if item.ref.alias is None else item.ref)
            outputs.append((item.label, f"g{fits[0]}"))
    kept = _collapsed(outputs)
    if any(_multiplying(scope, joins)) and _foldable(scope, where):
        for key in keys:
            require_groupable(key)
        df = _folded(scope, joins, where, keys, aggregates)
        results = finished(aggregates, "w0")
        df = df.select(*[k.column for k in named], *[a.alias(f"a{i}") for i, a in enumerate(results)])
    else:
        df = grouped(_joined(scope, joins, where), named, [aggregate_of(*a).alias(f"a{i}") for i, a in enumerate(aggregates)])
    return df.select(*[F.col(inner).alias(f"o{i}") for i, inner in enumerate(kept.values())]), list(kept)


def _foldable(scope: Scope, where: Where) -> bool:
    """Whether the columns that conditions on several sources compare can be grouped."""
    kinds = {n: t for s in scope.sources for n, t in s.frame.dtypes}
    return not any("map<" in kinds[n] for names, _ in where if not any(names <= set(s.inner.values()) for s in scope.sources) for n in names)


def _order_label(items: tuple[Item, ...], name: str) -> str:
    """The label of the first item that ``name`` means, else ``name`` itself."""
    for item in items:
        if isinstance(item, Star):
            continue
        names = [item.label.lower()]
        if isinstance(item, Field):
            names += [item.ref.name.lower(), str(item.ref).lower()]
        if name.lower() in names:
            return item.label
    return name
