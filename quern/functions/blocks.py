"""Ranges of whole numbers cut into aligned blocks, so that a number finds the ranges that hold it by equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks of one level are 2 ** BITS blocks of the level below; with so many levels every bigint has its block.
BITS, LEVELS = 4, 16
_NONE = "cast(array() as array<struct<level:int,block:bigint>>)"


def blocks_of(first: Column, end: Column) -> Column:
    """array<struct<level, block>>: the blocks that make up first..end (end exclusive), no two of which overlap; empty
    if end is not above first.

    A range of any length has at most 2 * (2 ** BITS - 1) blocks per level.
    """

    def blocks(k: Column, at: Column, n: Column) -> Column:
        return F.when(
            n > 0, F.transform(F.sequence(at, at + n - 1), lambda b: F.struct(k.alias("level"), b.alias("block")))
        ).otherwise(F.expr(_NONE))

    def step(acc: Column, k: Column) -> Column:
        a, b = acc["a"], acc["b"]
        low = F.lit((1 << BITS) - 1).cast("bigint")
        left = F.least((-a).bitwiseAND(low), b - a)
        right = F.when(a + left < b, b.bitwiseAND(low)).otherwise(F.lit(0).cast("bigint"))
        done = a + left >= b - right
        up = lambda x: F.when(done, F.lit(0)).otherwise(F.shiftright(x, BITS)).cast("bigint")
        return F.struct(
            up(a + left).alias("a"), up(b - right).alias("b"),
            F.concat(acc["blocks"], blocks(k, a, left), blocks(k, b - right, right)).alias("blocks")
        )

    start = F.struct(
        first.cast("bigint").alias("a"), F.greatest(end, first).cast("bigint").alias("b"), F.expr(_NONE).alias("blocks")
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, lambda acc: acc["blocks"])


def block_at(c: Column, levels: Column | None = None) -> Column:
    """array<bigint>: the one block of each level that holds ``c``, lowest level first; only the first ``levels``, if
    given."""
    every = F.array(*(F.shiftright(c.cast("bigint"), BITS * k) for k in range(LEVELS)))
    return every if levels is None else F.slice(every, F.lit(1), levels)
