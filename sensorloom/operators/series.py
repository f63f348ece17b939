"""Filling, smoothing and differencing along the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import names
from sensorloom.operators.blocks import BLOCK, KEY, POS, Blocks


def fill_gaps(
    grid: DataFrame, features: tuple[str, ...], max_rows: int | None = None, block_rows: int | None = None
) -> DataFrame:
    """Last known value, before the first known one that one; a feature without any stays NULL."""
    blocks = Blocks(max_rows, block_rows)
    others = [names.col(c) for c in grid.columns if c not in features]
    back = blocks.window().rowsBetween(Window.unboundedPreceding, 0)
    # rows without an earlier value all take the experiment's first one
    if blocks.whole:
        everything = Window.partitionBy(KEY).orderBy(POS).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
        filled = [
            F.coalesce(
                F.last(names.col(f), ignorenulls=True).over(back),
                F.first(names.col(f), ignorenulls=True).over(everything),
            ).alias(f)
            for f in features
        ]
        return grid.select(*others, *filled)
    grid = grid.withColumn(BLOCK, blocks.number())
    known = {f: F.when(names.col(f).isNotNull(), F.col(POS)) for f in features}
    edges = grid.groupBy(KEY, BLOCK).agg(
        *[F.max_by(names.col(f), known[f]).alias(f"last:{f}") for f in features],
        *[F.min_by(names.col(f), known[f]).alias(f"first:{f}") for f in features],
    )
    order = Window.partitionBy(KEY).orderBy(BLOCK)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = edges.select(
        KEY,
        BLOCK,
        *[F.last(names.col(f"last:{f}"), ignorenulls=True).over(earlier).alias(f"before:{f}") for f in features],
        *[F.first(names.col(f"first:{f}"), ignorenulls=True).over(everything).alias(f"first:{f}") for f in features],
    )
    filled = [
        F.coalesce(
            F.last(names.col(f), ignorenulls=True).over(back), names.col(f"before:{f}"), names.col(f"first:{f}")
        ).alias(f)
        for f in features
    ]
    return grid.join(carried, [KEY, BLOCK]).select(*others, *filled)


def smooth_centered(
    grid: DataFrame,
    features: tuple[str, ...],
    width: int,
    trim: bool = True,
    max_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Centred moving average over width rows, then the first n_points rows of each experiment.

    Trimming comes last, so the averages near the end still see the rows behind it.
    """
    smoothed = _moving_average(grid, features, width // 2, (width - 1) // 2, max_rows, block_rows)
    return smoothed.where(F.col(POS) < F.col("n_points")) if trim else smoothed


def smooth_trailing(
    grid: DataFrame,
    features: tuple[str, ...],
    width: int,
    max_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Moving average over a row and the width - 1 rows before it."""
    return _moving_average(grid, features, width - 1, 0, max_rows, block_rows)


def first_difference(
    grid: DataFrame, feature: str, name: str, max_rows: int | None = None, block_rows: int | None = None
) -> DataFrame:
    """Change from the row before; 0 on an experiment's first row."""
    blocks = Blocks(max_rows, block_rows)
    step = names.col(feature) - F.lag(names.col(feature)).over(blocks.window())
    changed = blocks.spread(grid, 1, 0).withColumn(
        name, F.when(F.col(POS) == 0, F.when(names.col(feature).isNotNull(), F.lit(0.0))).otherwise(step)
    )
    return blocks.own(changed)


def append_columns(grid: DataFrame, other: DataFrame) -> DataFrame:
    """The grid with another frame's columns at the same positions."""
    return grid.join(other, [KEY, POS])


def _moving_average(grid, features, before, after, max_rows, block_rows):
    blocks = Blocks(max_rows, block_rows)
    frame = blocks.window().rowsBetween(-before, after)
    others = [names.col(c) for c in grid.columns if c not in features]
    spread = blocks.spread(grid, before, after)
    extra = [] if blocks.whole else [F.col(BLOCK)]
    return blocks.own(
        spread.select(*others, *extra, *[F.avg(names.col(f)).over(frame).alias(f) for f in features])
    )
