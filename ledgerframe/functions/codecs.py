"""Codecs: how keys and records become bytes and come back, as pairs of column functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Codec:
    """``decode(encode(column))`` gives the column back; null stays null."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


#: Text as UTF-8; bytes that are no UTF-8 are an error.
UTF8 = Codec(lambda c: F.encode(c, "UTF-8"), lambda c: F.decode(c, "UTF-8"))


def json_codec(schema: str | T.StructType) -> Codec:
    """Structs as JSON text in UTF-8; text that doesn't fit the schema is an error."""
    options = {"mode": "FAILFAST"}
    return Codec(lambda c: F.encode(F.to_json(c, {"ignoreNullFields": "false"}), "UTF-8"), lambda c: F.from_json(F.decode(c, "UTF-8"), schema, options))
