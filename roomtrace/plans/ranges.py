"""Prefix queries as equality joins.

A query "value <= threshold" over ranks 0..n-1 is a union of at most log2(n)
aligned blocks of ranks, and every rank lies in log2(n) aligned blocks.  With
both sides listing their blocks, a range condition becomes an equality on a
block number and needs no nested loop.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block that holds every row, also those without a value.
ANY_BLOCK = -1
_LEVEL_SIZE = 1 << 40


def _block(level: Column, index: Column) -> Column:
    return level.cast("bigint") * F.lit(_LEVEL_SIZE) + index


def levels_for(n_thresholds: int) -> int:
    return max(n_thresholds.bit_length(), 1)


def blocks_of_rank(rank: Column, levels: int) -> Column:
    """Blocks that contain a rank, plus the catch-all; rank null: catch-all only."""
    own = F.array(*[_block(F.lit(lv), F.shiftright(rank, lv)) for lv in range(levels)])
    every = F.array(F.lit(ANY_BLOCK).cast("bigint"))
    return F.when(rank.isNull(), every).otherwise(F.concat(every, own))


def blocks_below(count: Column, levels: int) -> Column:
    """Blocks that together hold exactly the ranks 0..count-1; count null: the catch-all."""
    parts = [
        F.when(
            F.shiftright(count, lv).bitwiseAND(F.lit(1).cast("bigint")) == 1,
            _block(F.lit(lv), F.shiftright(count, lv + 1) * 2),
        )
        for lv in range(levels)
    ]
    every = F.array(F.lit(ANY_BLOCK).cast("bigint"))
    return F.when(count.isNull(), every).otherwise(F.array_compact(F.array(*parts)))
