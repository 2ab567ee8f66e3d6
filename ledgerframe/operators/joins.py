"""Inner equality joins in which NULL joins NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import family
from .predicates import Value, equal

#: Rows of a key on one side that meet the other side's in one piece.
BLOCK_ROWS = 1024


def join_condition(a: Value, b: Value) -> Column:
    """An equality that Spark plans by hash or sort-merge, never by nested loops.

    If either side is never null a plain ``==`` says the same; otherwise ``<=>``, which
    Spark splits into equality keys.  Keys of different families meet only where both are
    NULL, which is an equality of two flags.
    """
    if family(a.kind) != family(b.kind) or a.null or b.null:
        if a.required or b.required:
            return F.lit(False)
        return F.when(a.column.isNull(), F.lit(1)) == F.when(b.column.isNull(), F.lit(1))
    return equal(a, b)


def inner_join(left: DataFrame, right: DataFrame, a: Value, b: Value) -> DataFrame:
    """Rows of both sides with equal keys; Spark picks the strategy and splits skewed keys."""
    return left.join(right, join_condition(a, b), "inner")


def dealt_join(left: DataFrame, right: DataFrame, a: Value, b: Value, left_ids: Sequence[str], right_ids: Sequence[str]) -> DataFrame:
    """The same rows for a join that multiplies them, in tasks of even size.

    The rows of a hot key are cut into blocks of about ``BLOCK_ROWS`` on both sides, and each
    pair of blocks is a tile of its own; a row is copied for the other side's blocks, so the
    copies are about two in ``BLOCK_ROWS`` of the result's rows.  ``ids`` are columns that tell a
    side's rows apart.  Partitions are dealt by tile and their number is fixed: by the bytes of
    its input Spark would take a join that makes millions of rows for one small task.
    """
    if family(a.kind) != family(b.kind) or a.null or b.null:
        if a.required or b.required:
            return inner_join(left, right, a, b)
        flags, safe = [F.when(v.column.isNull(), F.lit(1)) for v in (a, b)], False
    else:
        equal(a, b)
        flags, safe = [a.column, b.column], not (a.required or b.required)
    counted = left.select(flags[0].alias("jk"), F.lit(1).alias("jl"), F.lit(0).alias("jr")).unionAll(right.select(flags[1].alias("jk"), F.lit(0).alias("jl"), F.lit(1).alias("jr")))
    sizes = (counted if safe else counted.where(F.col("jk").isNotNull())).groupBy("jk").agg(F.sum("jl").alias("jl"), F.sum("jr").alias("jr"))
    hot = sizes.where((F.col("jl") > 0) & (F.col("jr") > 0) & ((F.col("jl") > BLOCK_ROWS) | (F.col("jr") > BLOCK_ROWS)))
    kind, parts = sizes.schema["jk"].dataType, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tiles(frame: DataFrame, key: Column, ids: Sequence[str], own: str, other: str) -> DataFrame:
        blocks = lambda n: F.coalesce(F.ceil(F.col(n) / BLOCK_ROWS), F.lit(1))
        held = frame.join(hot, key.eqNullSafe(F.col("jk")), "left")
        mine = held.withColumn(f"{own}b", F.pmod(F.xxhash64(*ids), blocks(own))).withColumn(f"{other}b", F.explode(F.sequence(F.lit(0).cast("long"), blocks(other) - 1)))
        tile = F.xxhash64(key.cast(kind), F.col("jlb"), F.col("jrb")).alias(f"{own}t")
        return mine.select(*frame.columns, tile).repartition(parts, f"{own}t")

    one, two = tiles(left, flags[0], left_ids, "jl", "jr"), tiles(right, flags[1], right_ids, "jr", "jl")
    same = flags[0].eqNullSafe(flags[1]) if safe else flags[0] == flags[1]
    # tiles of different keys may have one hash; the comparison that can't hold keeps Spark from
    # taking the key itself for a join key, by which it would deal the rows again
    tile = (F.col("jlt") == F.col("jrt")) & (same | (F.col("jlt") < F.col("jrt")))
    return one.join(two, tile, "inner").select(*left.columns, *right.columns)
