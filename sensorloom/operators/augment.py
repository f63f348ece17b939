"""More experiments from the ones there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import names
from sensorloom.functions.hashing import digest, gaussian, uniform
from sensorloom.operators.positions import shuffled
from sensorloom.operators.series import smooth_trailing
from sensorloom.settings import JITTER_LEVEL, SYNTHETIC_ID_START


def jitter(
    grid: DataFrame,
    features: tuple[str, ...],
    samples: int,
    width: int,
    level: float = JITTER_LEVEL,
    seed: int = 0,
    max_rows: int | None = None,
) -> DataFrame:
    """New experiments: one picked with replacement, normal noise on every value, trailing smoothing.

    Picks and noise come from digests of sample, position, feature and seed. Ids start at 2000, or
    behind the largest id if that is not free; samples keep the times of the picked experiment.
    """
    ids = grid.select("experiment_id").distinct()
    count, largest = ids.agg(F.count("*"), F.max("experiment_id")).first()
    if not count:
        raise ValueError("no experiment to take samples from")
    start = SYNTHETIC_ID_START if largest < SYNTHETIC_ID_START else largest + 1
    placed = shuffled(ids, digest(F.col("experiment_id"), seed), ["experiment_id"], "pick")
    sample = F.col("sample")
    picks = grid.sparkSession.range(samples).select(
        F.col("id").alias("sample"),
        F.floor(uniform(F.col("id"), seed, "pick") * count).alias("pick"),
    )
    noisy = (
        grid.join(picks.join(placed, "pick").drop("pick"), "experiment_id")
        .withColumn("experiment_id", sample + start)
        .select(
            *[names.col(c) for c in grid.columns if c not in features],
            *[
                (names.col(f) + F.lit(float(level)) * gaussian(sample, F.col("idx"), f, seed)).alias(f)
                for f in features
            ],
        )
    )
    return smooth_trailing(noisy, features, width, max_rows)


def with_samples(grid: DataFrame, samples: DataFrame) -> DataFrame:
    """Real and synthetic experiments in one grid."""
    return grid.unionByName(samples)
