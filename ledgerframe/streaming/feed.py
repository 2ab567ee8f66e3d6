"""Change feeds and upserts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.changelog import SEQ, latest_per_key
from ..store import RecordStore


def change_stream(store: RecordStore, max_files: int = 1000) -> DataFrame:
    """All changes of a store as a stream, batch after batch (key, record, deleted, seq).

    It reads the log's folders as they appear; ``vacuum`` must wait for its readers.
    """
    reader = store.spark.readStream.schema(store.log.full).option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{store.log.path}/log/*")


def follow(store: RecordStore, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Call ``handler(changes, batch)`` with the last change of each key of every micro-batch.

    A batch is repeated with its number after a failure, so handlers can skip what they know.
    """
    writer = change_stream(store).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda df, batch: handler(latest_per_key(df, SEQ), batch))
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_stream(changes: DataFrame, store: RecordStore, checkpoint: str, name: str, order: str, once: bool = True) -> StreamingQuery:
    """Write a stream of (key, record, ``_deleted``, ``order``) to a store.

    Each micro-batch becomes one batch of the log with the last change of each key; the
    batch number is kept in the manifest, so repeats after a failure do nothing.
    """
    writer = changes.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda df, batch: store.append(df, order=order, token=(name, batch)))
    return (writer.trigger(availableNow=True) if once else writer).start()
