"""Splits, shuffles and batches in a seeded order that does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.hashing import digest
from sensorloom.operators.positions import shuffled
from sensorloom.operators.windows import sliding_windows
from sensorloom.settings import SPLIT_SEED, WindowSpec


def group_split(experiments: DataFrame, validation_share: float, seed: int = SPLIT_SEED) -> DataFrame:
    """Each experiment's split: the first ceil(n * (1 - share)) of the shuffled ids train, the rest validate."""
    if not 0.0 <= validation_share <= 1.0:
        raise ValueError(f"validation_share must lie in 0..1, got {validation_share}")
    ids = experiments.select("experiment_id").distinct()
    placed = shuffled(ids, digest(F.col("experiment_id"), seed), ["experiment_id"], "position", "total")
    train = F.ceil(F.col("total") * F.lit(1.0 - validation_share))
    return placed.select(
        "experiment_id",
        "position",
        F.when(F.col("position") < train, F.lit("train")).otherwise(F.lit("validation")).alias("split"),
    )


def split_windows(windows: DataFrame, split: DataFrame) -> DataFrame:
    """Windows with the split of their experiment, which none of them straddles."""
    # windows of a small file look small to Spark, which would send them all through the driver; they stay where they were built
    return windows.join(split.select("experiment_id", "split").hint("shuffle_hash"), "experiment_id")


def batches(windows: DataFrame, batch_size: int, seed: int = SPLIT_SEED, epoch: int = 0) -> DataFrame:
    """Windows in a new order per epoch with batch_id and place in the batch; only full batches stay.

    Only keys are put in order; the windows join their places. Windows that are cut from a grid take less with batched_windows.
    """
    # neither side is ever broadcast, however small its estimate
    return _full_batches(windows.join(_places(windows, seed, epoch).hint("merge"), ["experiment_id", "j"]), batch_size)


def batched_windows(
    grid: DataFrame, spec: WindowSpec, batch_size: int, seed: int = SPLIT_SEED, epoch: int = 0, max_rows: int | None = None
) -> DataFrame:
    """The batches of a grid's sliding windows. Places are joined to grid rows, so no window is exchanged after it is built; give a stored grid."""
    places = _places(sliding_windows(grid, spec, max_rows), seed, epoch).withColumnRenamed("j", "idx")
    placed = grid.join(places, ["experiment_id", "idx"], "left")
    return _full_batches(sliding_windows(placed, spec, max_rows, carried=("_position", "_rows")), batch_size)


def _places(windows: DataFrame, seed: int, epoch: int) -> DataFrame:
    key = digest(F.col("experiment_id"), F.col("j"), seed, epoch)
    return shuffled(windows.select("experiment_id", "j"), key, ["experiment_id", "j"], "_position", "_rows")


def _full_batches(placed: DataFrame, batch_size: int) -> DataFrame:
    if batch_size < 1:
        raise ValueError(f"batch_size must be at least 1, got {batch_size}")
    batch = F.call_function("div", F.col("_position"), F.lit(batch_size).cast("long"))
    full = F.call_function("div", F.col("_rows"), F.lit(batch_size).cast("long"))
    return (
        placed.withColumn("batch_id", batch)
        .withColumn("place", F.col("_position") % batch_size)
        .where(F.col("batch_id") < full)
        .drop("_position", "_rows")
    )
