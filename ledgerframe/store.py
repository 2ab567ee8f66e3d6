"""A keyed record store on a change log.

Every operation takes whole DataFrames; the forms for one key are thin wrappers.  Records are
rows with ``_key`` and the store's columns.  A batch must hold each key at most once, unless
an ``order`` column says which of its changes is the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sources.catalog import KEY
from .sources.changelog import DELETED, ChangeLog, Version, latest_per_key

#: Bits of the key hash by which eviction counts keys.
CELL_BITS = 12


def _schema(key: str, record: str | T.StructType) -> T.StructType:
    fields = (T.StructType.fromDDL(record) if isinstance(record, str) else record).fields
    if any(f.name.lower() in (KEY, "_deleted", "_seq") for f in fields):
        raise ValueError("A record cannot have columns _key, _deleted or _seq")
    return T.StructType([*T.StructType.fromDDL(f"{KEY} {key}").fields, *fields])


class RecordStore:
    """Records by key, durable as soon as a call returns."""

    def __init__(self, spark: SparkSession, path: str, key: str, record: str | T.StructType):
        self.spark = spark
        self.log = ChangeLog(spark, path, _schema(key, record))
        self.columns = list(self.log.records)
        self._listeners: list[Callable[[DataFrame], None]] = []
        self._most: int | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str = "string", record: str | T.StructType = "value string") -> RecordStore:
        return cls(spark, path, key, record)

    @classmethod
    def strings(cls, spark: SparkSession, path: str) -> RecordStore:
        return cls(spark, path, "string", "value string")

    @classmethod
    def memory(cls, spark: SparkSession, key: str = "string", record: str | T.StructType = "value string") -> RecordStore:
        """A store that nobody opens again, in the shared folder ``spark.checkpoint.dir``."""
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        return cls(spark, f"{top.rstrip('/')}/store-{uuid.uuid4().hex}", key, record)

    # reading

    def current(self) -> DataFrame:
        """All records of the newest version."""
        return self.log.current()

    def get(self, key: object, default: dict | None = None) -> dict | None:
        row = self.current().where(F.col(KEY) == F.lit(key)).limit(1).first()
        return default if row is None else {c: row[c] for c in self.columns}

    def contains_key(self, key: object) -> bool:
        return self.get(key) is not None

    def contains_value(self, record: Mapping[str, object]) -> bool:
        same = F.lit(True)
        for c in self.columns:
            same = same & F.col(f"`{c}`").eqNullSafe(F.lit(record.get(c)))
        return not self.current().where(same).isEmpty()

    def size(self) -> int:
        return self.current().count()

    def is_empty(self) -> bool:
        return self.current().isEmpty()

    def keys(self) -> DataFrame:
        return self.current().select(KEY)

    # writing

    def frame(self, records: Mapping[object, Mapping[str, object]]) -> DataFrame:
        """A few records given as a dictionary, as a DataFrame."""
        rows = [(k, *[r.get(c) for c in self.columns]) for k, r in records.items()]
        return self.spark.createDataFrame(rows, self.log.schema)

    def key_frame(self, keys: Iterable[object]) -> DataFrame:
        return self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], T.StructType([self.log.schema[KEY]]))

    def put_all(self, records: DataFrame, order: str | None = None) -> None:
        """Insert or replace; with ``order`` only a key's last record counts."""
        if order is not None:
            records = latest_per_key(records.select(KEY, *self._fields(), F.col(f"`{order}`").alias("_order")), "_order")
        self._commit(records.withColumn(DELETED, F.lit(False)))
        self._evict()

    def put(self, key: object, **record: object) -> dict | None:
        """The previous record, or None."""
        before = self.get(key)
        self.put_all(self.frame({key: record}))
        return before

    def put_if_absent(self, records: DataFrame) -> int:
        """Insert records whose key is new; returns how many."""
        return self._changed(records.join(self.keys(), KEY, "left_anti"), False, evict=True)

    def replace(self, records: DataFrame) -> int:
        """Replace records whose key is there; returns how many."""
        return self._changed(records.join(self.keys(), KEY, "left_semi"), False)

    def replace_if(self, records: DataFrame, expected: DataFrame) -> int:
        """Replace records whose current one equals the key's row in ``expected``; returns how many."""
        return self._changed(records.join(self._matching(expected), KEY, "left_semi"), False)

    def remove_all(self, keys: DataFrame) -> bool:
        """Delete keys; only those that are there get a tombstone.  Whether there was any."""
        gone = self.keys().join(keys.select(KEY).distinct(), KEY, "left_semi")
        return self._changed(gone, True) > 0

    def remove(self, key: object) -> dict | None:
        before = self.get(key)
        if before is not None:
            self.remove_all(self.key_frame([key]))
        return before

    def remove_if(self, expected: DataFrame) -> int:
        """Delete keys whose current record equals the row in ``expected``; returns how many."""
        return self._changed(self._matching(expected), True)

    def clear(self) -> None:
        self._changed(self.keys(), True)

    def compute(self, keys: DataFrame, new: Callable[[Column], Column]) -> int:
        """Replace the records of ``keys`` (further columns allowed) by ``new(old)``.

        ``old`` is a struct of the record, null where the key is new; ``new`` may use the
        other columns of ``keys`` and gives a struct in schema order, or null to delete.
        Returns how many keys changed.
        """
        old = self.current().select(KEY, F.struct(*self._fields()).alias("_old"))
        both = keys.join(old, KEY, "left")
        both = both.withColumn("_new", new(F.col("_old"))).where("_old IS NOT NULL OR _new IS NOT NULL")
        both = both.where(~F.col("_new").eqNullSafe(F.col("_old")))
        rows = both.select(KEY, *[F.col("_new").getField(c).alias(c) for c in self.columns], F.col("_new").isNull().alias(DELETED))
        return self._count(self._commit(rows), evict=True)

    def merge(self, records: DataFrame, combine: Callable[[Column, Column], Column]) -> int:
        """Insert new keys; where there is a record, ``combine(old, new)`` (null deletes)."""
        rows = records.select(KEY, F.struct(*self._fields()).alias("_mine"))
        return self.compute(rows, lambda old: F.when(old.isNull(), F.col("_mine")).otherwise(combine(old, F.col("_mine"))))

    def replace_all(self, new: Callable[[Column], Column]) -> int:
        """``new(old)`` for every record."""
        return self.compute(self.keys(), new)

    def append(self, changes: DataFrame, order: str | None = None, token: tuple[str, int] | None = None) -> None:
        """A batch of upserts and (where ``_deleted``) deletes, as a stream delivers them."""
        if order is not None:
            changes = latest_per_key(changes.select(KEY, *self._fields(), DELETED, F.col(f"`{order}`").alias("_order")), "_order")
        self._commit(changes, token)
        self._evict()

    # upkeep

    def flush(self) -> None:
        """Nothing is pending: every call has written its batch before it returns."""

    def close(self) -> None:
        """Nothing stays open."""

    def compact(self) -> None:
        self.log.compact()

    def vacuum(self) -> None:
        self.log.vacuum()

    def sort_by(self, column: str) -> None:
        """Let the next compaction sort files by ``column`` (after those declared before)."""
        now = self.log.version()
        if column not in now.sort:
            self.log.publish(Version(now.number + 1, now.seq, now.base, now.log, now.tokens, (*now.sort, column)))

    def evict_at(self, most: int) -> RecordStore:
        """From now on, when there are more than ``most`` keys, delete down to 90 % of it."""
        if most < 1:
            raise ValueError("the limit must be positive")
        self._most = most
        self._evict()
        return self

    def on_change(self, listener: Callable[[DataFrame], None]) -> None:
        """Call ``listener`` with every batch of changes after it is written."""
        self._listeners.append(listener)

    def _fields(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.columns]

    def _matching(self, expected: DataFrame) -> DataFrame:
        wanted = expected.select(KEY, F.struct(*self._fields()).alias("_wanted"))
        found = self.current().select(KEY, F.struct(*self._fields()).alias("_found"))
        return found.join(wanted, KEY).where("_found <=> _wanted").select(KEY)

    def _commit(self, changes: DataFrame, token: tuple[str, int] | None = None) -> DataFrame | None:
        written = self.log.append(changes, token)
        if written is not None:
            for listener in self._listeners:
                listener(written)
        return written

    def _changed(self, rows: DataFrame, deleted: bool, evict: bool = False) -> int:
        if deleted:
            rows = rows.select(KEY, *[F.lit(None).cast(self.log.schema[c].dataType).alias(c) for c in self.columns])
        return self._count(self._commit(rows.withColumn(DELETED, F.lit(deleted))), evict)

    def _count(self, written: DataFrame | None, evict: bool = False) -> int:
        if evict:
            self._evict()
        return 0 if written is None else written.count()

    def _evict(self) -> None:
        if self._most is not None:
            gone = evicted(self.current(), self._most)
            if gone is not None:
                self._changed(gone, True)


def evicted(records: DataFrame, most: int) -> DataFrame | None:
    """Keys to delete: if there are more than ``most``, those with the smallest key hashes.

    What stays is ``most - max(1, most // 10)`` keys.  Keys are counted in cells of their
    hash (a bounded table); whole cells go, and only the cell in which the cut falls is sorted.
    """
    hashed = records.select(KEY, F.xxhash64(KEY).alias("_hash"))
    cell = F.shiftrightunsigned("_hash", 64 - CELL_BITS)
    counts = dict(hashed.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(counts.values())
    if total <= most:
        return None
    left = total - (most - max(1, most // 10))
    edge = 0
    for edge in sorted(counts):
        if left <= counts[edge]:
            break
        left -= counts[edge]
    whole = hashed.where(cell < edge).select(KEY)
    return whole.unionByName(hashed.where(cell == edge).orderBy("_hash", KEY).limit(left).select(KEY))
