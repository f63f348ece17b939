"""Training and prediction windows over the grid, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import names
from sensorloom.operators.blocks import KEY, POS, Blocks
from sensorloom.settings import WindowSpec


def sliding_windows(
    grid: DataFrame, spec: WindowSpec, max_rows: int | None = None, block_rows: int | None = None, carried: tuple[str, ...] = ()
) -> DataFrame:
    """All windows (experiment_id, j, history, label, controlled, carried...) with H <= j < N - P.

    The last position that would still fit is left out, so N rows give N - P - H windows. Carried columns keep their value at j.
    """
    return _windows(grid, spec, F.lit(True), max_rows, block_rows, carried)


def predict_windows(
    grid: DataFrame, spec: WindowSpec, max_rows: int | None = None, block_rows: int | None = None
) -> DataFrame:
    """Every 2P-th window, without those whose history or controlled part is all zero.

    A missing value counts as not zero. Without controlled features only the history counts.
    """
    step = (F.col(POS) - spec.steps_history) % (2 * spec.steps_prediction) == 0
    usable = _any_nonzero("history")
    if spec.controlled:
        usable = usable & _any_nonzero("controlled")
    return _windows(grid, spec, step, max_rows, block_rows).where(usable)


def complete(windows: DataFrame) -> DataFrame:
    """Windows without any missing value."""
    parts = [c for c in ("history", "label", "controlled") if c in windows.columns]
    condition = F.lit(True)
    for part in parts:
        condition = condition & ~F.exists(F.flatten(part), lambda x: x.isNull())
    return windows.where(condition)


def window_means(windows: DataFrame, spec: WindowSpec) -> DataFrame:
    """Mean of each history feature over the window's steps."""
    return windows.select(
        KEY, "j", *[_mean_of("history", position).alias(f) for position, f in enumerate(spec.history)]
    )


def unwindow(windows: DataFrame, spec: WindowSpec) -> DataFrame:
    """Rebuild (experiment_id, idx, history and controlled columns) from any set of windows.

    Each window gives the rows that the next window of its experiment does not hold, so nothing is exploded H-fold.
    Positions outside the windows stay NULL.
    """
    following = Window.partitionBy(KEY).orderBy("j")
    tagged = windows.withColumn("_own", F.lead("j").over(following) - F.col("j"))
    columns = [f"h:{f}" for f in spec.history] + [f"c:{f}" for f in spec.controlled]
    rows = _placed("history", F.col("j") - spec.steps_history, 0, spec)
    if spec.controlled:
        rows = F.concat(rows, _placed("controlled", F.col("j"), len(spec.history), spec))
    placed = tagged.select(KEY, F.inline(rows)).select(
        KEY, POS, *[F.col("_values")[i].alias(c) for i, c in enumerate(columns)]
    )
    return placed.groupBy(KEY, POS).agg(*[F.max(names.col(c)).alias(c) for c in columns])


def prediction_timeline(grid: DataFrame, predictions: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """The grid with <feature>_PREDICTED columns, filled at positions j .. j+P-1 of each prediction."""
    placed = predictions.select(KEY, "j", F.posexplode("prediction").alias("_step", "_row")).select(
        KEY,
        (F.col("j") + F.col("_step")).alias(POS),
        *[F.col("_row")[i].alias(f"{f}_PREDICTED") for i, f in enumerate(features)],
    )
    return grid.join(placed, [KEY, POS], "left")


def _windows(grid, spec, keep: Column, max_rows, block_rows, carried=()):
    blocks = Blocks(max_rows, block_rows)
    before, after = spec.steps_history, spec.steps_prediction
    order = blocks.window()
    past = order.rowsBetween(-before, -1)
    coming = order.rowsBetween(0, after - 1)
    spread = blocks.spread(grid.select(KEY, POS, *carried, *_columns(spec)), before, after)
    # one struct field per frame keeps the rows in the window buffer narrow
    built = spread.select(
        "*",
        F.collect_list(_row(spec.history)).over(past).alias("history"),
        F.collect_list(_row(spec.prediction)).over(coming).alias("label"),
        F.collect_list(_row(spec.controlled)).over(coming).alias("controlled"),
        F.lead(POS, after).over(order).alias("_beyond"),
    )
    usable = built.where((F.col(POS) >= before) & F.col("_beyond").isNotNull() & keep)
    return blocks.own(usable).select(KEY, F.col(POS).alias("j"), "history", "label", "controlled", *carried)


def _columns(spec: WindowSpec) -> list[Column]:
    distinct = dict.fromkeys((*spec.history, *spec.prediction, *spec.controlled))
    return [names.col(f).cast("float").alias(f) for f in distinct]


def _row(features: tuple[str, ...]) -> Column:
    return F.array(*[names.col(f) for f in features]).cast("array<float>")


def _mean_of(part: str, position: int) -> Column:
    values = F.transform(part, lambda row: row[position].cast("double"))
    known = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 0, total / F.size(known))


def _any_nonzero(part: str) -> Column:
    return F.exists(F.flatten(part), lambda x: x.isNull() | (x != 0.0))


def _placed(part: str, start: Column, offset: int, spec: WindowSpec) -> Column:
    """Rows of a window part with their position, values moved to the part's place among all columns."""
    width = len(spec.history) + len(spec.controlled)
    own = len(spec.history) if part == "history" else len(spec.controlled)
    missing = F.lit(None).cast("float")
    before = F.array_repeat(missing, offset)
    behind = F.array_repeat(missing, width - offset - own)
    count = F.least(F.size(part).cast("bigint"), F.coalesce("_own", F.size(part).cast("bigint"))).cast("int")
    taken = F.slice(F.col(part), F.lit(1), count)
    return F.transform(
        taken,
        lambda row, step: F.struct((start + step).alias(POS), F.concat(before, row, behind).alias("_values")),
    )
