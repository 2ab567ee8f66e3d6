"""The change log: immutable Parquet batches, a snapshot, and a manifest that names them.

A version is one manifest file, published by rename after its data is complete.  Folders
that no manifest names (left by a failed write) are never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import KEY
from .files import Files

DELETED, SEQ = "_deleted", "_seq"


@dataclass(frozen=True)
class Version:
    number: int = 0
    seq: int = 0
    base: str | None = None
    log: tuple[str, ...] = ()
    tokens: dict[str, int] = field(default_factory=dict)
    sort: tuple[str, ...] = ()


def latest_per_key(changes: DataFrame, order: str) -> DataFrame:
    """Of all changes of a key the one with the largest ``order``.

    Partial maxima per task come before the shuffle, so a hot key sends one row a task.
    """
    rest = [c for c in changes.columns if c != KEY]
    last = changes.groupBy(KEY).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(order)).alias("last"))
    return last.select(KEY, *[F.col("last").getField(c).alias(c) for c in rest])


class ChangeLog:
    """Batches of (key, record, deleted, seq) under ``path``; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.records = [f.name for f in schema.fields if f.name != KEY]
        self.full = T.StructType([*schema.fields, T.StructField(DELETED, T.BooleanType()), T.StructField(SEQ, T.LongType())])
        self.files = Files(spark, self.path)

    def version(self) -> Version:
        """The newest version; the first one is empty."""
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        if not names:
            return Version()
        raw = json.loads(self.files.read(f"manifest/{names[-1]}"))
        return Version(**raw | {"log": tuple(raw["log"]), "sort": tuple(raw["sort"])})

    def publish(self, v: Version) -> None:
        self.files.publish(f"manifest/{v.number:012d}.json", json.dumps(asdict(v)))

    def read(self, *names: str) -> DataFrame:
        return self.spark.read.schema(self.full).parquet(*[f"{self.path}/{n}" for n in names])

    def append(self, changes: DataFrame, token: tuple[str, int] | None = None) -> DataFrame | None:
        """Write one batch (key, record columns, deleted); returns it as written.

        ``token`` (stream, batch number) makes repeats of a streaming batch do nothing.
        """
        now = self.version()
        if token is not None and now.tokens.get(token[0], -1) >= token[1]:
            return None
        name = f"log/{now.seq + 1:012d}-{uuid.uuid4().hex[:8]}"
        key = F.coalesce(F.col(KEY), F.raise_error(F.lit("A key cannot be null")).cast(self.schema[KEY].dataType))
        rows = changes.select(key.alias(KEY), *[F.col(f"`{c}`") for c in self.records], F.col(DELETED), F.lit(now.seq + 1).cast("long").alias(SEQ))
        rows.write.parquet(f"{self.path}/{name}")
        tokens = now.tokens | ({token[0]: token[1]} if token else {})
        self.publish(Version(now.number + 1, now.seq + 1, now.base, (*now.log, name), tokens, now.sort))
        return self.read(name)

    def tail(self) -> DataFrame | None:
        """The last change of every key since the snapshot."""
        now = self.version()
        return latest_per_key(self.read(*now.log), SEQ) if now.log else None

    def current(self) -> DataFrame:
        """Key and record of every live key.

        The snapshot isn't shuffled for a short log: its rows lose the changed keys by an
        anti-join, whose small side Spark broadcasts, and gain the log's last states.
        """
        now = self.version()
        columns = [KEY, *[f"`{c}`" for c in self.records]]
        if now.base is None and not now.log:
            return self.spark.createDataFrame([], self.schema)
        base = self.read(now.base).select(*columns) if now.base else None
        if not now.log:
            return base
        tail = self.tail()
        live = tail.where(f"NOT {DELETED}").select(*columns)
        return live if base is None else base.join(tail.select(KEY), KEY, "left_anti").select(*columns).unionByName(live)

    def compact(self) -> None:
        """Write the current state as the new snapshot; the old version stays valid until then."""
        now = self.version()
        if not now.log:
            return
        name = f"base/{now.seq:012d}-{uuid.uuid4().hex[:8]}"
        rows = self.current().withColumns({DELETED: F.lit(False), SEQ: F.lit(now.seq).cast("long")})
        # the key comes last, so that rows with one hot value still spread over tasks and files
        by = tuple(dict.fromkeys((*now.sort, KEY)))
        rows.repartitionByRange(*[F.col(f"`{c}`") for c in by]).sortWithinPartitions(*[F.col(f"`{c}`") for c in by]).write.parquet(f"{self.path}/{name}")
        self.publish(Version(now.number + 1, now.seq, name, (), now.tokens, now.sort))

    def vacuum(self) -> None:
        """Delete what the newest version doesn't name.  Readers of older versions and feeds must be done."""
        now = self.version()
        wanted = {now.base, *now.log}
        for folder in ("base", "log"):
            for name in self.files.names(folder):
                if f"{folder}/{name}" not in wanted:
                    self.files.remove(f"{folder}/{name}")
        for name in self.files.names("manifest"):
            if name != f"{now.number:012d}.json":
                self.files.remove(f"manifest/{name}")
