"""The 64-bit FNV-1a hash, as a SQL expression and in Python.

Spark's multiplication is checked, so the expression keeps the hash as two halves of 32 bits;
the prime is 2**40 + 435, hence a product is a shift by 40 bits plus a product with 435, which
fits in a long for each half.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a.
OFFSET = 0xCBF29CE484222325
PRIME = 0x100000001B3

_SMALL = PRIME - (1 << 40)
_LOW = (1 << 32) - 1


def fnv1a(data: bytes) -> int:
    h = OFFSET
    for byte in data:
        h = ((h ^ byte) * PRIME) & ((1 << 64) - 1)
    return h


def fnv1a_halves(data: Column) -> Column:
    """A struct (hi, lo) with the halves of the hash of a binary column; null for null."""
    digits = F.hex(data)
    octets = F.transform(
        F.filter(F.sequence(F.lit(0), F.length(data)), lambda i: i < F.length(data)),
        lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long"),
    )
    start = F.struct(F.lit(OFFSET >> 32).alias("hi"), F.lit(OFFSET & _LOW).alias("lo"))

    def step(h: Column, octet: Column) -> Column:
        low = h["lo"].bitwiseXOR(octet)
        product = low * _SMALL
        high = h["hi"] * _SMALL + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), product.bitwiseAND(F.lit(_LOW)).alias("lo"))

    return F.when(data.isNotNull(), F.aggregate(octets, start, step))


def fnv1a_modulo(data: Column, n: int) -> Column:
    """The hash, read as an unsigned number, modulo ``n``."""
    h = fnv1a_halves(data)
    return F.when(data.isNotNull(), ((h["hi"] % n) * ((1 << 32) % n) + h["lo"]) % n).cast("int")
