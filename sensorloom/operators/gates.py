"""Choice of experiments, and why an experiment is turned away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import names
from sensorloom.settings import EXPERIMENT_BATCHES, FAULTY_EXPERIMENTS, Grid

REJECTS = "experiment_id bigint, stage string, reason string"


def batch_table(spark, batches: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    rows = [(name, lo, hi) for name, (lo, hi) in (batches or EXPERIMENT_BATCHES).items()]
    return spark.createDataFrame(rows, "batch string, lo bigint, hi bigint")


ALL = "all"


def expand_batches(batches: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per id of each batch (batch, experiment_id); with known ids, batch 'all' has every one of them."""
    named = batches.select("batch", F.explode(F.sequence("lo", "hi")).alias("experiment_id"))
    if known is None:
        return named
    return named.unionByName(known.select(F.lit(ALL).alias("batch"), "experiment_id").distinct())


def faulty_table(spark, ids: tuple[int, ...] = FAULTY_EXPERIMENTS) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "experiment_id bigint")


def exclude_faulty(experiments: DataFrame, faulty: DataFrame) -> DataFrame:
    """Distinct ids without the faulty ones, ascending."""
    kept = experiments.select("experiment_id").distinct().join(faulty, "experiment_id", "left_anti")
    return kept.orderBy("experiment_id")


def choose_experiments(spark, choice: str | list[int], known: DataFrame | None = None) -> DataFrame:
    """The ids a specification names: a list, a batch, or 'all' known ones; any other name gives none."""
    if choice == ALL:
        if known is None:
            raise ValueError("'all' needs the known experiments")
        ids = known
    elif isinstance(choice, str):
        ids = expand_batches(batch_table(spark).where(F.col("batch") == choice))
    else:
        ids = spark.createDataFrame([(int(i),) for i in choice], "experiment_id bigint")
    return exclude_faulty(ids, faulty_table(spark))


def incomplete(extent: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Experiments without a point for some required feature, from the counts n:<feature>."""
    missing = F.array_compact(
        F.array(*[F.when(names.col(f"n:{f}") == 0, F.lit(f)) for f in features])
    )
    return extent.where(F.size(missing) > 0).select(
        "experiment_id", F.lit("scan").alias("stage"), F.concat(F.lit("no data for "), missing[0]).alias("reason")
    )


def duplicated(aligned: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Experiments with two points of a feature at one time, from aligned rows."""
    twice = reduce(lambda a, b: a | b, [names.col(f"n:{f}") > 1 for f in features])
    return aligned.where(twice).groupBy("experiment_id").agg(
        F.lit("scan").alias("stage"), F.lit("duplicate timestamp").alias("reason")
    )


def duplicated_readings(readings: DataFrame) -> DataFrame:
    """As duplicated, from readings: one exchange on (experiment, feature, time)."""
    twice = readings.groupBy("experiment_id", "feature", "ts").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return twice.groupBy("experiment_id").agg(
        F.lit("scan").alias("stage"), F.lit("duplicate timestamp").alias("reason")
    )


def out_of_limits(extent: DataFrame, grid: Grid) -> DataFrame:
    """Experiments too long, or too short for one grid point."""
    reason = F.when(F.col("minutes") * 60 > grid.max_duration_s, F.lit("too long")).when(
        F.col("n_points") < 1, F.lit("too short")
    )
    return extent.where(reason.isNotNull()).select(
        "experiment_id", F.lit("preprocess").alias("stage"), reason.alias("reason")
    )


def without_range(readings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Experiments with a feature that has no normalization range."""
    unknown = readings.select("experiment_id", "feature").distinct().join(
        ranges.select("feature"), "feature", "left_anti"
    )
    return unknown.groupBy("experiment_id").agg(
        F.lit("preprocess").alias("stage"),
        F.concat(F.lit("no range for "), F.min("feature")).alias("reason"),
    )


def absent(experiments: DataFrame, extent: DataFrame) -> DataFrame:
    """Wanted experiments without any reading."""
    return experiments.select("experiment_id").join(extent.select("experiment_id"), "experiment_id", "left_anti").select(
        "experiment_id", F.lit("scan").alias("stage"), F.lit("no data").alias("reason")
    )


def too_short_for_windows(grid: DataFrame, steps: int) -> DataFrame:
    """Experiments whose grid has no more rows than the steps of a training window, which gives them no window."""
    lengths = grid.groupBy("experiment_id").agg((F.max("idx") + 1).alias("_n"))
    return lengths.where(F.col("_n") <= steps).select(
        "experiment_id", F.lit("train").alias("stage"), F.lit("too short for a window").alias("reason")
    )


def first_rejects(*found: DataFrame) -> DataFrame:
    """All rejects in one table, each experiment once with the earliest failing check."""
    ranked = [r.withColumn("_rank", F.lit(rank)) for rank, r in enumerate(found)]
    union = reduce(lambda a, b: a.unionByName(b), ranked)
    return union.groupBy("experiment_id").agg(
        F.min_by("stage", "_rank").alias("stage"), F.min_by("reason", "_rank").alias("reason")
    )


def accept(df: DataFrame, rejects: DataFrame) -> DataFrame:
    return df.join(rejects.select("experiment_id"), "experiment_id", "left_anti")
