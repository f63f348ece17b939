"""Curves of fixed length, descriptions of experiments, and choosing by cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import names
from sensorloom.operators.blocks import fits_one_block
from sensorloom.operators.quantiles import exact_quantiles
from sensorloom.session import keep
from sensorloom.settings import CLUSTER_FEATURES, CURVE_POINTS


def cluster_feature(columns: list[str]) -> str:
    """The temperature experiments are compared by."""
    for feature in CLUSTER_FEATURES:
        if feature in columns:
            return feature
    raise ValueError(f"none of {CLUSTER_FEATURES} in the data")


def resample_curve(grid: DataFrame, feature: str, points: int = CURVE_POINTS) -> DataFrame:
    """Linear interpolation of a feature at evenly spaced positions (experiment_id, curve).

    Each grid row gives its weighted share to the samples next to it, so an experiment of any length
    is summed up before it is exchanged. A sample next to a missing value is missing.
    """
    lengths = grid.groupBy("experiment_id").agg((F.max("idx") + 1).alias("_n"))
    idx = F.col("idx").cast("double")
    step = (F.col("_n") - 1) / F.lit(float(points - 1))
    low = F.when(F.col("_n") > 1, F.floor((idx - 1) / step)).otherwise(F.lit(0))
    high = F.when(F.col("_n") > 1, F.ceil((idx + 1) / step)).otherwise(F.lit(points - 1))
    near = (
        grid.join(lengths, "experiment_id")
        .select(
            "experiment_id",
            "idx",
            "_n",
            names.col(feature).alias("_v"),
            F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(points - 1)))).alias("_k"),
        )
        .withColumn("_w", 1.0 - F.abs(F.col("_k") * (F.col("_n") - 1) / F.lit(float(points - 1)) - F.col("idx")))
        .where(F.col("_w") > 0.0)
    )
    samples = near.groupBy("experiment_id", "_k").agg(
        F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.count_if(F.col("_v").isNull()).alias("_missing")
    )
    sample = F.struct("_k", F.when(F.col("_missing") == 0, F.col("_s")).alias("_s"))
    return samples.groupBy("experiment_id").agg(
        F.transform(F.sort_array(F.collect_list(sample)), lambda s: s["_s"]).alias("curve")
    )


def resample_array(curves: DataFrame, points: int = CURVE_POINTS) -> DataFrame:
    """The same for curves that already are arrays."""
    last = F.size("curve") - 1

    def sample(k: Column) -> Column:
        at = k * last / F.lit(float(points - 1))
        low = F.floor(at).cast("int")
        left = F.get("curve", low)
        right = F.get("curve", F.least(low + 1, last))
        return F.when(at == low, left).otherwise(left + (right - left) * (at - low))

    return curves.withColumn("curve", F.transform(F.sequence(F.lit(0), F.lit(points - 1)), sample))


QUARTILES = [0.25, 0.5, 0.75]


def describe(grid: DataFrame, feature: str, max_rows: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated quartiles per experiment.

    Where max_rows is a proven limit on the rows of an experiment and small, one aggregation holds an experiment's values; else the
    quartiles come from rounds of range counts, whatever the length.
    """
    value = names.col(feature)
    bounded = fits_one_block(max_rows)
    grid = grid if bounded else keep(grid.select("experiment_id", value.alias("_value")), "described")
    value = value if bounded else F.col("_value")
    moments = grid.groupBy("experiment_id").agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *([F.percentile(value, QUARTILES).alias("quantiles")] if bounded else []),
    )
    if not bounded:
        moments = moments.join(exact_quantiles(grid, ["experiment_id"], value, QUARTILES), "experiment_id")
    quartiles = [F.get("quantiles", F.lit(k)).alias(name) for k, name in enumerate(("q25", "q50", "q75"))]
    return moments.select("experiment_id", "count", "mean", "std", "min", *quartiles, "max")


def cluster_scores(described: DataFrame, members: DataFrame) -> DataFrame:
    """Squared distance of each member's mean and deviation from its cluster's; 0 for a single member."""
    joined = members.select("experiment_id", "cluster").join(described, "experiment_id")
    centres = joined.groupBy("cluster").agg(
        F.avg("mean").alias("cluster_mean"), F.avg("std").alias("cluster_std")
    )
    off_mean = F.col("mean") - F.col("cluster_mean")
    off_std = F.col("std") - F.col("cluster_std")
    return joined.join(centres, "cluster").select(
        "cluster",
        "experiment_id",
        "cluster_mean",
        "cluster_std",
        ((off_mean * off_mean + off_std * off_std) / 2.0).alias("score"),
    )


def cluster_top_n(scores: DataFrame, per_cluster: int) -> DataFrame:
    """The lowest scores of each cluster, ties by experiment id; rank from 1."""
    order = Window.partitionBy("cluster").orderBy(F.asc_nulls_last("score"), "experiment_id")
    ranked = scores.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= per_cluster)


def cluster_members(members: DataFrame, clusters: int) -> DataFrame:
    """One row per cluster and member with the cluster's size; an empty cluster gives one row with NULL."""
    every = members.sparkSession.range(clusters).select(F.col("id").alias("cluster"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    # the sizes are the small side, so a large cluster is not gathered for the join
    known = members.join(sizes, "cluster").select("cluster", "experiment_id", "size")
    empty = every.join(sizes, "cluster", "left_anti").select(
        "cluster", F.lit(None).cast("bigint").alias("experiment_id"), F.lit(0).cast("bigint").alias("size")
    )
    return known.unionByName(empty)


def select_experiments(grid: DataFrame, chosen: DataFrame) -> DataFrame:
    return grid.join(chosen.select("experiment_id"), "experiment_id", "left_semi")


def center_trim(grid: DataFrame) -> DataFrame:
    """Every experiment cut to the shortest one's length, the surplus taken off both ends."""
    lengths = grid.groupBy("experiment_id").agg((F.max("idx") + 1).alias("_n"))
    starts = lengths.withColumn("_shortest", lengths.agg(F.min("_n")).scalar()).select(
        "experiment_id", "_shortest", F.expr("(_n - _shortest) div 2").alias("_start")
    )
    kept = grid.join(starts, "experiment_id").where(
        (F.col("idx") >= F.col("_start")) & (F.col("idx") < F.col("_start") + F.col("_shortest"))
    )
    return kept.withColumn("idx", F.col("idx") - F.col("_start")).drop("_start", "_shortest")


def resize_plan(experiments: int, minimum: int, maximum: int | None, clusters: int) -> tuple[str, int]:
    """What to do with a set of this size: ('augment', how many), ('cluster', how many per cluster) or ('keep', 0)."""
    if experiments < minimum:
        return "augment", minimum - experiments
    if maximum is not None and experiments > maximum:
        return "cluster", max(maximum // clusters, 1)
    return "keep", 0


def resize_decision(count: Column, minimum: int, maximum: int, clusters: int) -> tuple[Column, Column]:
    """The same as columns over a count."""
    action = F.when(count < minimum, "augment").when(count > maximum, "cluster").otherwise("keep")
    amount = (
        F.when(count < minimum, F.lit(minimum) - count)
        .when(count > maximum, F.lit(max(maximum // clusters, 1)))
        .otherwise(F.lit(0))
    )
    return action, amount.cast("long")


# ids of one range, whose text is put together in one task
RANGE_IDS = 100_000


def experiments_digest(experiments: DataFrame) -> DataFrame:
    """One digest of a set of ids: md5 over the md5 of each range of RANGE_IDS ids, in order, one per line.

    The text of a range is its ids in ascending order, one per line. A set of any size has this one definition.
    """
    ids = experiments.select("experiment_id").distinct()
    ranges = ids.groupBy(F.floor(F.col("experiment_id") / RANGE_IDS).alias("_range")).agg(
        _text_digest(F.col("experiment_id")).alias("_digest")
    )
    entry = F.sort_array(F.collect_list(F.struct("_range", "_digest")))
    return ranges.agg(F.md5(F.array_join(F.transform(entry, lambda e: e["_digest"]), "\n")).alias("digest"))


def list_digest(experiments: DataFrame) -> DataFrame:
    """The md5 of a list of ids, ascending and one per line, as data sets of at most RANGE_IDS experiments are versioned.

    The text of a list is put together in one task, so a longer one is an error; experiments_digest has no limit.
    """
    ids = experiments.select("experiment_id").distinct()
    longer = F.raise_error(F.lit(f"more than {RANGE_IDS} ids"))
    # ids beyond the limit are counted, not gathered
    first = ids.orderBy("experiment_id").limit(RANGE_IDS).agg(_text_digest(F.col("experiment_id")).alias("digest"))
    count = ids.agg(F.count("*")).scalar()
    return first.select(F.when(count > RANGE_IDS, longer.cast("string")).otherwise(F.col("digest")).alias("digest"))


def _text_digest(ids: Column) -> Column:
    return F.md5(F.array_join(F.transform(F.sort_array(F.collect_set(ids)), lambda i: i.cast("string")), "\n"))
