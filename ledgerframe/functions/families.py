"""Type families: which values may be compared, ordered and summed.

There are no casts between families: values of different families are never equal and
can't be ordered.  Within a family Spark's own coercion applies.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
#: Families whose values have an order.
ORDERED = frozenset(("number", "string", "boolean", "date", "timestamp", "timestamp_ntz"))


def family(kind: T.DataType) -> str | None:
    """The family of a type; None for the type of a bare NULL."""
    if isinstance(kind, T.NullType):
        return None
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return kind.simpleString() if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else kind.typeName()


def constant(value: object, peer: T.DataType | None = None) -> tuple[Column, T.DataType]:
    """A constant as a column.  A naive ``datetime`` is a local time, unless ``peer`` is an instant."""
    if value is None:
        return F.lit(None), T.NullType()
    if isinstance(value, bool):
        return F.lit(value), T.BooleanType()
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise ValueError(f"Integer out of range: {value}")
        return F.lit(value).cast("long"), T.LongType()
    if isinstance(value, float):
        return F.lit(value), T.DoubleType()
    if isinstance(value, str):
        return F.lit(value), T.StringType()
    if isinstance(value, Decimal):
        return F.lit(value), T.DecimalType(38, max(0, -value.as_tuple().exponent))
    if isinstance(value, (bytes, bytearray)):
        return F.lit(bytes(value)), T.BinaryType()
    if isinstance(value, datetime):
        if value.tzinfo is not None or isinstance(peer, T.TimestampType):
            return F.lit(value), T.TimestampType()
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz"), T.TimestampNTZType()
    if isinstance(value, date):
        return F.lit(value), T.DateType()
    raise ValueError(f"Unsupported parameter type: {type(value).__name__}")


def require_summable(kind: T.DataType, function: str) -> None:
    if not isinstance(kind, (*INTEGRAL, *FLOATING, T.NullType)):
        raise ValueError(f"{function.upper()} requires a number, not {kind.simpleString()}")


def require_ordered(kind: T.DataType, what: str) -> None:
    if family(kind) not in ORDERED and not isinstance(kind, T.NullType):
        raise ValueError(f"{what} requires comparable values, not {kind.simpleString()}")
