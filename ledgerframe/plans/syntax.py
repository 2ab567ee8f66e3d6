"""Statements as immutable values."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Union

AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Ref:
    """A column as written, with the alias before its last dot."""

    alias: str | None
    name: str

    def __str__(self) -> str:
        return self.name if self.alias is None else f"{self.alias}.{self.name}"

    def fits(self, other: Ref) -> bool:
        """Equal names; equal aliases unless one has none."""
        same = self.name.lower() == other.name.lower()
        return same and (self.alias is None or other.alias is None or self.alias.lower() == other.alias.lower())


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Param:
    name: str


Operand = Union[Ref, Literal, Param]


@dataclass(frozen=True)
class Comparison:
    left: Operand
    op: str
    right: Operand


@dataclass(frozen=True)
class Both:
    left: Condition
    right: Condition


@dataclass(frozen=True)
class Either:
    left: Condition
    right: Condition


Condition = Union[Comparison, Both, Either]


def refs(condition: Condition) -> list[Ref]:
    """The columns of a condition."""
    parts = [condition.left, condition.right]
    if isinstance(condition, Comparison):
        return [p for p in parts if isinstance(p, Ref)]
    return [r for p in parts for r in refs(p)]


@dataclass(frozen=True)
class Star:
    label: str | None = None


@dataclass(frozen=True)
class Field:
    ref: Ref
    label: str


@dataclass(frozen=True)
class Aggregate:
    function: str
    ref: Ref | None
    label: str


Item = Union[Star, Field, Aggregate]


@dataclass(frozen=True)
class Source:
    table: str
    alias: str


@dataclass(frozen=True)
class Join:
    source: Source
    left: Ref
    right: Ref


@dataclass(frozen=True)
class Order:
    name: str
    descending: bool


@dataclass(frozen=True)
class Statement:
    items: tuple[Item, ...]
    source: Source
    joins: tuple[Join, ...]
    where: Condition | None
    groups: tuple[Ref, ...]
    orders: tuple[Order, ...]
    limit: int | None

    @property
    def grouped(self) -> bool:
        return bool(self.groups) or any(isinstance(i, Aggregate) for i in self.items)

    @property
    def streamable(self) -> bool:
        """Scan, filter, projection and LIMIT only."""
        return not (self.joins or self.grouped or self.orders)
