"""Stable key partitions, an ownership table, and stores that are routed by it."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import fnv1a, fnv1a_modulo
from .sources.catalog import KEY
from .store import RecordStore


@dataclass(frozen=True)
class Node:
    """A named place; ``location`` is the folder of its stores."""

    name: str
    location: str = ""

    def __post_init__(self) -> None:
        if not self.name or not self.name.strip():
            raise ValueError("A node needs a name")


def partition_of(key: str | bytes, partitions: int) -> int:
    """The partition of one key: FNV-1a of its bytes (UTF-8 for text), unsigned, modulo."""
    if partitions < 1:
        raise ValueError("partitions must be positive")
    return fnv1a(key.encode() if isinstance(key, str) else key) % partitions


def partition_column(key: Column, partitions: int) -> Column:
    """The same for a column, which is read as text unless it is binary; null for null."""
    if partitions < 1:
        raise ValueError("partitions must be positive")
    return fnv1a_modulo(F.encode(key.cast("string"), "UTF-8"), partitions)


@dataclass(frozen=True)
class Topology:
    """Which node owns each of a fixed number of partitions.  Changes give new values."""

    nodes: tuple[Node, ...]
    owners: tuple[str, ...]

    def __post_init__(self) -> None:
        names = [n.name for n in self.nodes]
        if not names:
            raise ValueError("At least one node is required")
        if not self.owners:
            raise ValueError("At least one partition is required")
        if len(set(names)) < len(names):
            raise ValueError("Node names must differ")
        if strangers := set(self.owners) - set(names):
            raise ValueError(f"Unknown owner: {', '.join(sorted(strangers))}")

    @classmethod
    def evenly(cls, partitions: int, nodes: Sequence[Node]) -> Topology:
        if partitions < 1:
            raise ValueError("partitions must be positive")
        if not nodes:
            raise ValueError("At least one node is required")
        return cls(tuple(nodes), tuple(nodes[i % len(nodes)].name for i in range(partitions)))

    @classmethod
    def assigned(cls, nodes: Sequence[Node], owners: Sequence[str]) -> Topology:
        return cls(tuple(nodes), tuple(owners))

    @property
    def partitions(self) -> int:
        return len(self.owners)

    def owner(self, partition: int) -> Node:
        if not 0 <= partition < self.partitions:
            raise ValueError(f"Invalid partition: {partition}")
        return next(n for n in self.nodes if n.name == self.owners[partition])

    def reassign(self, changes: Mapping[int, str]) -> Topology:
        """Other owners for some partitions."""
        owners = list(self.owners)
        for partition, owner in changes.items():
            self.owner(partition)
            owners[partition] = owner
        return Topology(self.nodes, tuple(owners))

    def rebalance(self, nodes: Sequence[Node]) -> Topology:
        """All partitions dealt out anew over other nodes."""
        return Topology.evenly(self.partitions, nodes)

    def with_nodes(self, nodes: Sequence[Node]) -> Topology:
        """Other nodes under the same ownership."""
        return Topology(tuple(nodes), self.owners)

    def table(self, spark: SparkSession) -> DataFrame:
        """The ownership table: one row per partition."""
        return spark.createDataFrame(list(enumerate(self.owners)), "partition int, owner string")

    def place(self, df: DataFrame, key: str = KEY) -> DataFrame:
        """``df`` with ``partition`` and ``owner``.

        The ownership table has one row per partition, which is fixed and small, so it is
        broadcast.  Rows with a null key keep a null partition and owner.
        """
        placed = df.withColumn("partition", partition_column(F.col(f"`{key}`"), self.partitions))
        return placed.join(F.broadcast(self.table(df.sparkSession)), "partition", "left")


class RoutedStore:
    """One logical store over a store per node: every key lives with its owner alone.

    A batch is written once per node that owns some of its keys.  Nothing is replicated, and
    a new topology moves no data.
    """

    def __init__(self, spark: SparkSession, name: str, topology: Topology, key: str = "string", record: str = "value string"):
        if not re.fullmatch(r"[A-Za-z0-9._-]+", name or ""):
            raise ValueError(f"Invalid store name: {name}")
        self.spark, self.name, self._topology = spark, name, topology
        self._key, self._record = key, record
        self._stores: dict[str, RecordStore] = {}

    def store(self, node: Node) -> RecordStore:
        if node.name not in self._stores:
            self._stores[node.name] = RecordStore.open(self.spark, f"{node.location.rstrip('/')}/{self.name}", self._key, self._record)
        return self._stores[node.name]

    @property
    def topology(self) -> Topology:
        return self._topology

    @topology.setter
    def topology(self, new: Topology) -> None:
        if new.partitions != self._topology.partitions:
            raise ValueError("The number of partitions cannot change")
        self._topology = new

    def owner(self, key: str) -> Node:
        return self._topology.owner(partition_of(str(key), self._topology.partitions))

    def get(self, key: str) -> dict | None:
        return self.store(self.owner(key)).get(key)

    def put(self, key: str, **record: object) -> None:
        store = self.store(self.owner(key))
        store.put_all(store.frame({key: record}))

    def remove(self, key: str) -> bool:
        store = self.store(self.owner(key))
        return store.remove_all(store.key_frame([key]))

    def put_all(self, records: DataFrame) -> None:
        for store, batch in self._batches(records):
            store.put_all(batch)

    def remove_all(self, keys: DataFrame) -> None:
        for store, batch in self._batches(keys):
            store.remove_all(batch)

    def shards(self) -> list[DataFrame]:
        """The current records of each node, for :meth:`Catalog.add_shards`."""
        return [self.store(n).current() for n in self._topology.nodes]

    def _batches(self, rows: DataFrame) -> Iterable[tuple[RecordStore, DataFrame]]:
        placed = self._topology.place(rows).drop("partition")
        for node in self._topology.nodes:
            if node.name in self._topology.owners:
                mine = placed.where(F.col("owner") == node.name).drop("owner")
                if not mine.isEmpty():
                    yield self.store(node), mine
