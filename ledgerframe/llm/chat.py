"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context and
only that reply is trainable.  A conversation that doesn't end with an assistant turn gives
one more row without a trainable part, so that no turn is lost.

A turn is written as ``<|turn|>role<|says|>text<|done|>``.  Inside roles and texts each
backslash, ``<`` and ``[`` gets a backslash behind it.  That breaks every control string of
this and other common templates after its first character, so none can appear there, not
even as a part of an escaped one; dropping the added backslashes restores the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
_ESCAPED = re.compile(r"([\\<\[])\\")
_BODY = r"((?:[^\\<\[]++|[\\<\[]\\)*+)"
_TURNS = re.compile(rf"<\|turn\|>{_BODY}<\|says\|>{_BODY}<\|done\|>")
#: Characters of examples per Arrow batch.
BATCH_CHARS = 1 << 21

SCHEMA = "conv_id long, example long, text string, loss_start long, loss_end long, complete boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def escaped(column):
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"([\\<\[])", r"$1\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text; anything else in it is an error."""
    out, at = [], 0
    for m in _TURNS.finditer(text):
        if m.start() != at:
            raise ValueError(f"not a formatted turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"not a formatted turn at {at}")
    return out


def format_chat(conversations: DataFrame) -> DataFrame:
    """Examples of all conversations (columns of ``SCHEMA``), a conversation's rows in order.

    ``text[loss_start:loss_end]`` (code points) is the only trainable part; both are null in
    a row without one.  ``complete`` marks the row that holds the whole conversation.  Null
    roles and texts are empty; rows with a null ``conv_id`` form one conversation; rows are
    ordered by turn (nulls first), then role and text, repeated rows are kept; extra columns
    are ignored.  Rows are dealt by conversation and streamed in order: a task holds one
    conversation's text, which its last example has to hold as well.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        (F.col("role") == "assistant").alias("own"), escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"),
    )
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("complete", pa.bool_())])
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for example in _examples(batches):
            out.append(example)
            size += len(example[2])
            if size > BATCH_CHARS:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return rows.mapInArrow(run, SCHEMA)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, example, text, loss_start, loss_end, complete) of rows in order."""
    now: object = ()
    text, example, held = "", 0, None
    for batch in batches:
        for conv, own, role, said in zip(batch["conv_id"].to_pylist(), batch["own"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()):
            if conv != now:
                if now != ():
                    yield (*held, True) if held else (now, example, text, None, None, True)
                now, text, example, held = conv, "", 0, None
            elif held:
                yield (*held, False)
                held = None
            start = len(text) + len(TURN) + len(role) + len(SAYS)
            text = f"{text}{TURN}{role}{SAYS}{said}{DONE}"
            if own:
                held = (now, example, text, start, start + len(said))
                example += 1
    if now != ():
        yield (*held, True) if held else (now, example, text, None, None, True)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from its examples (columns of ``DIGESTS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        loss, loss_chars, chars, n = hashlib.sha256(), 0, 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                chars += len(row["text"])
                if row["loss_start"] is not None:
                    said = unescape(row["text"][row["loss_start"] : row["loss_end"]])
                    loss.update(said.encode())
                    loss_chars += len(said)
                    n += 1
                if row["complete"]:
                    turns = read_turns(row["text"])
                    whole = hashlib.sha256()
                    for role, said in turns:
                        whole.update(f"{role}\n{said}\n".encode())
                    out.append((row["conv_id"], len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), chars, n))
                    loss, loss_chars, chars, n = hashlib.sha256(), 0, 0, 0
            if out:
                types = [pa.string() if "sha" in k else pa.int64() for k in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names=names)

    return examples.mapInArrow(run, DIGESTS)


#: The extra conversation of the query, whose texts are made of control strings.
PROBE = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return digests(format_chat(rows.unionByName(probe)))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), n AS (
  SELECT *, length('<|turn|><|says|><|done|>') + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'gs')) AS n,
    row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), r AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR i = turns), 0) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM r GROUP BY conv_id
"""
