"""Exact quantiles of groups of any size on bounded memory.

Quantiles between two values are interpolated, so each needs the values at one or two ranks. All ranks of all groups are narrowed down together: a
round sketches the values of each rank's interval (percentile_approx), takes the two sketched values that lie a few hundredths of the rows below and above
the rank, and counts exactly what lies below, between and above them. The side that holds the rank is the next interval, about a hundredth of the rows
whatever their distribution. A rank is done when its interval has at most SMALL values or one value only; the last values are sorted in place.
Sketches and counts are summed up on the map side, so no task holds more than a sketch or SMALL values of a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.session import keep

PIVOTS = 256
ACCURACY = 4 * PIVOTS
SMALL = 4096
MOST_ROUNDS = 32


def exact_quantiles(
    values: DataFrame, keys: list[str], value: Column, shares: list[float], small: int = SMALL
) -> DataFrame:
    """(keys, quantiles): an array with the interpolated quantile of each share; missing values are left out, a group without values has NULLs."""
    stored = keep(values.select(*keys, value.cast("double").alias("_v")), "values")
    known = stored.where(F.col("_v").isNotNull())
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares))))
    columns = [*keys, "_rank", "_lo", "_hi", "_n", "_before"]
    found = keep(sizes.withColumn("_rank", F.explode(ranks)).withColumn("_before", F.lit(0).cast("long")).select(*columns), "ranks")
    wide = (F.col("_n") > small) & (F.col("_lo") < F.col("_hi"))
    for turn in range(MOST_ROUNDS + 1):
        if found.where(wide).isEmpty():
            break
        if turn == MOST_ROUNDS:
            raise RuntimeError("ranks do not narrow down")
        found = keep(found.where(~wide).unionByName(_narrowed(known, found.where(wide), keys).select(*columns)), "ranks")
    single = F.col("_lo") == F.col("_hi")
    equal = found.where(single).select(*keys, "_rank", F.col("_lo").alias("_value"))
    rest = known.join(found.where(~single), keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    listed = rest.groupBy(*keys, "_rank").agg(F.any_value("_before").alias("_before"), F.sort_array(F.collect_list("_v")).alias("_all"))
    sorted_ones = listed.select(*keys, "_rank", F.get("_all", (F.col("_rank") - F.col("_before")).cast("int")).alias("_value"))
    at = equal.unionByName(sorted_ones).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    low = lambda p: F.col("_at")[F.floor(place(p))]
    high = lambda p: F.col("_at")[F.ceil(place(p))]
    between = [low(p) + (high(p) - low(p)) * (place(p) - F.floor(place(p))) for p in shares]
    quantiles = sizes.select(*keys, "_n").join(at, keys).select(*keys, F.array(*between).alias("quantiles"))
    empty = stored.select(*keys).distinct().join(sizes.select(*keys), keys, "left_anti")
    return quantiles.unionByName(empty.select(*keys, F.array(*(F.lit(None).cast("double") for _ in shares)).alias("quantiles")))


def _narrowed(known: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    inside = known.join(wide, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    grid = [k / PIVOTS for k in range(PIVOTS + 1)]
    # the middle of the rank's share of the rows
    place = F.floor((F.col("_rank") - F.col("_before") + 0.5) / F.col("_n") * PIVOTS).cast("int")
    pivots = inside.groupBy(*keys, "_rank", "_before", "_n").agg(F.percentile_approx("_v", grid, ACCURACY).alias("_q"))
    pivots = pivots.select(
        *keys,
        F.col("_rank"),
        F.get("_q", F.greatest(place - 1, F.lit(0))).alias("_a"),
        F.get("_q", F.least(place + 2, F.lit(PIVOTS))).alias("_b"),
    )
    side = F.when(F.col("_v") < F.col("_a"), 0).when(F.col("_v") <= F.col("_b"), 1).otherwise(2)
    counted = inside.join(pivots, [*keys, "_rank"]).groupBy(*keys, "_rank", "_before", side.alias("_side")).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    upto = Window.partitionBy(*keys, "_rank").orderBy("_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counted.withColumn("_upto", F.col("_before") + F.sum("_n").over(upto))
    held = summed.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank")))
    return held.withColumn("_before", F.col("_upto") - F.col("_n"))
