"""Windows over grid positions that never need a whole experiment in one task.

A grid is dense: idx runs 0, 1, 2, ... within an experiment. When a limit on the rows per experiment
is known (the duration gate gives one) and it is small, windows are partitioned by experiment. In
any other case positions are cut into blocks of BLOCK_ROWS, every row is copied to the neighbouring
blocks whose frames reach it, and windows are partitioned by experiment and block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 32_768
KEY = "experiment_id"
POS = "idx"
BLOCK = "_block"


def fits_one_block(max_rows: int | None) -> bool:
    return max_rows is not None and max_rows <= BLOCK_ROWS


class Blocks:
    """How one operator's windows are partitioned."""

    def __init__(self, max_rows: int | None = None, block_rows: int | None = None):
        self.rows = block_rows or BLOCK_ROWS
        self.whole = block_rows is None and fits_one_block(max_rows)

    def number(self):
        return F.floor(F.col(POS) / self.rows)

    def spread(self, grid: DataFrame, before: int, after: int) -> DataFrame:
        """Copy rows to each block that needs them for frames [-before, after]."""
        if self.whole:
            return grid
        first = F.floor(F.greatest(F.col(POS) - after, F.lit(0)) / self.rows)
        last = F.floor((F.col(POS) + before) / self.rows)
        return grid.withColumn(BLOCK, F.explode(F.sequence(first, last)))

    def window(self) -> WindowSpec:
        keys = [KEY] if self.whole else [KEY, BLOCK]
        return Window.partitionBy(*keys).orderBy(POS)

    def own(self, grid: DataFrame) -> DataFrame:
        """Drop the copies again."""
        if self.whole:
            return grid
        return grid.where(F.col(BLOCK) == self.number()).drop(BLOCK)
