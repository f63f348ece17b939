"""Extent of experiments, mean per chunk, and the dense time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import names, scaling
from sensorloom.operators.blocks import BLOCK_ROWS, fits_one_block
from sensorloom.settings import DEFAULT_RANGES, Grid


def norm_ranges(spark, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The range table (feature, lo, hi); the default ranges if none are given."""
    rows = [(f, float(lo), float(hi)) for f, (lo, hi) in (ranges or DEFAULT_RANGES).items()]
    return spark.createDataFrame(rows, "feature string, lo double, hi double")


def with_ranges(readings: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """lo and hi of each row's feature, from the specification's table (tens of entries)."""
    lo = F.lit(None).cast("double")
    hi = F.lit(None).cast("double")
    for feature, (low, high) in ranges.items():
        lo = F.when(F.col("feature") == feature, F.lit(float(low))).otherwise(lo)
        hi = F.when(F.col("feature") == feature, F.lit(float(high))).otherwise(hi)
    return readings.withColumn("lo", lo).withColumn("hi", hi)


def null_outliers(readings: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values on or outside their feature's limits become NULL."""
    ranged = with_ranges(readings, ranges)
    return ranged.withColumn("value", scaling.inside(F.col("value"), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def outlier_share(
    readings: DataFrame, ranges: dict[str, tuple[float, float]], alert_percent: float = 10.0
) -> DataFrame:
    """Share of newly missing values per experiment and feature, in percent of its aligned rows.

    Aligned rows are the experiment's distinct timestamps over all features, so every feature of an
    experiment has the same denominator.
    """
    ranged = with_ranges(readings, ranges)
    kept = scaling.inside(F.col("value"), F.col("lo"), F.col("hi"))
    flagged = ranged.select(
        "experiment_id",
        "feature",
        "ts",
        F.col("value").isNull().cast("int").alias("was_missing"),
        kept.isNull().cast("int").alias("is_missing"),
    )
    per_feature = flagged.groupBy("experiment_id", "feature").agg(
        F.count("*").alias("points"),
        F.sum("was_missing").alias("was_missing"),
        F.sum("is_missing").alias("is_missing"),
    )
    aligned = (
        readings.groupBy("experiment_id", "ts").agg(F.lit(1).alias("one"))
        .groupBy("experiment_id").agg(F.count("*").alias("aligned_rows"))
    )
    removed = F.col("is_missing") - F.col("was_missing")
    share = removed * 100.0 / F.col("aligned_rows")
    return per_feature.join(aligned, "experiment_id").select(
        "experiment_id",
        "feature",
        "aligned_rows",
        (F.col("aligned_rows") - F.col("points") + F.col("was_missing")).alias("missing_before"),
        (F.col("aligned_rows") - F.col("points") + F.col("is_missing")).alias("missing_after"),
        share.alias("outlier_percent"),
        (share > alert_percent).alias("alert"),
    )


def experiment_extent(readings: DataFrame, grid: Grid, by_feature: tuple[str, ...] = ()) -> DataFrame:
    """First and last time per experiment over all features, whole minutes, and grid points.

    With feature names given, their point counts are taken in the same pass (n:<feature>).
    """
    us = F.unix_micros("ts")
    counts = [
        F.count(F.when(F.col("feature") == f, F.lit(1))).alias(f"n:{f}") for f in by_feature
    ]
    found = readings.groupBy("experiment_id").agg(
        F.min(us).alias("first_us"), F.max(us).alias("last_us"), *counts
    )
    return _with_points(found, grid)


def bin_readings(
    readings: DataFrame,
    features: tuple[str, ...],
    grid: Grid,
    ranges: dict[str, tuple[float, float]] | None = None,
    extent: DataFrame | None = None,
) -> DataFrame:
    """Mean of each feature per chunk with readings: (experiment_id, bin, <feature>..., n:<feature>...).

    Chunks start at midnight of an experiment's first day. Where the chunk divides the day, all
    midnights fall on the same raster and readings are summed up before anything is exchanged; only
    odd chunk lengths need each experiment's first day beforehand. Limits in ranges null outliers
    on the way.
    """
    us = F.unix_micros("ts")
    if grid.divides_day:
        offset = us
    else:
        anchors = (extent if extent is not None else experiment_extent(readings, grid)).select(
            "experiment_id", _anchor(grid).alias("_anchor")
        )
        readings = readings.join(anchors, "experiment_id")
        offset = us - F.col("_anchor")
    measures = []
    for feature in features:
        value = F.when(F.col("feature") == feature, F.col("value"))
        if ranges is not None:
            value = scaling.inside(value, *ranges[feature])
        measures.append(F.avg(value).alias(feature))
        measures.append(F.count(F.when(F.col("feature") == feature, F.lit(1))).alias(f"n:{feature}"))
    return readings.groupBy("experiment_id", _bin(offset, grid).alias("bin")).agg(
        *measures, F.min(us).alias("first_us"), F.max(us).alias("last_us")
    )


def extent_of_bins(binned: DataFrame, features: tuple[str, ...], grid: Grid) -> DataFrame:
    """The result of experiment_extent from binned readings, so that raw ones are scanned once."""
    found = binned.groupBy("experiment_id").agg(
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        *[F.sum(names.col(f"n:{f}")).alias(f"n:{f}") for f in features],
    )
    return _with_points(found, grid)


def within_limits(extent: DataFrame, grid: Grid) -> DataFrame:
    """Experiments that are long enough for one grid point and not longer than the limit."""
    return extent.where((F.col("n_points") >= 1) & (F.col("minutes") * 60 <= grid.max_duration_s))


def dense_grid(binned: DataFrame, extent: DataFrame, features: tuple[str, ...], grid: Grid) -> DataFrame:
    """Every chunk from an experiment's first to its last: (experiment_id, idx, ts, n_points, <feature>...).

    extent decides which experiments come out; give it gated. Empty chunks are made from the
    distance to the next chunk with readings, on the partitioning the later windows use.
    """
    spans = _spans(extent, grid)
    values = [names.col(f) for f in features]
    rows = binned.select("experiment_id", "bin", *values).join(spans, "experiment_id")
    return _filled(rows.select(*_SPAN, (F.col("bin") - F.col("_first_bin")).alias("idx"), *values), spans, features, grid)


_SPAN = ("experiment_id", "n_points", "_first_bin", "_last_idx", "_anchor")


def _spans(extent: DataFrame, grid: Grid, *others: Column) -> DataFrame:
    last_idx = _bin(F.col("last_us") - _anchor(grid), grid) - F.col("_first_bin")
    first = extent.withColumn("_first_bin", _bin(F.col("first_us") - _anchor(grid), grid))
    return first.select("experiment_id", "n_points", "_first_bin", last_idx.alias("_last_idx"), _anchor(grid).alias("_anchor"), *others)


def _gated_rows(binned: DataFrame, features: tuple[str, ...], grid: Grid) -> DataFrame:
    """Bins of experiments within the limits, each with its experiment's span, on the partitioning by experiment that the later windows use.

    The extent is a window over an experiment's own bins. Only its first bins are looked at, one more than an experiment within the limits can
    have: those of a longer one already span too much. Spark drops the others before the exchange.
    """
    whole = Window.partitionBy("experiment_id")
    values = [names.col(f) for f in features]
    number = F.row_number().over(whole.orderBy("bin"))
    few = binned.select("experiment_id", "bin", "first_us", "last_us", *values, number.alias("_number")).where(
        F.col("_number") <= grid.max_rows + 1
    )
    ends = few.withColumn("first_us", F.min("first_us").over(whole)).withColumn("last_us", F.max("last_us").over(whole))
    spans = _spans(within_limits(_with_points(ends, grid), grid), grid, F.col("bin"), *values)
    return spans.select(*_SPAN, (F.col("bin") - F.col("_first_bin")).alias("idx"), *values)


def _filled(rows: DataFrame, spans: DataFrame | None, features: tuple[str, ...], grid: Grid) -> DataFrame:
    """All chunks of rows that have their experiment's span; spans are needed only where an experiment takes several blocks."""
    if fits_one_block(grid.max_rows):
        order = Window.partitionBy("experiment_id").orderBy("idx")
        until = F.coalesce(F.lead("idx").over(order), F.col("idx") + 1)
    else:
        block = F.floor(F.col("idx") / BLOCK_ROWS)
        starts = spans.withColumn(
            "idx", F.explode(F.sequence(F.lit(0), F.col("_last_idx"), F.lit(BLOCK_ROWS)))
        )
        rows = rows.withColumn("_start", F.lit(False)).unionByName(
            starts.withColumn("_start", F.lit(True)), allowMissingColumns=True
        ).withColumn("_block", block)
        order = Window.partitionBy("experiment_id", "_block").orderBy("idx", F.desc("_start"))
        end = F.least(F.col("_last_idx"), (F.col("_block") + 1) * BLOCK_ROWS - 1) + 1
        until = F.coalesce(F.lead("idx").over(order), end)
    filled = (
        rows.withColumn("_until", until)
        .where(F.col("_until") > F.col("idx"))
        .withColumn("_at", F.explode(F.sequence(F.col("idx"), F.col("_until") - 1)))
    )
    return filled.select(
        "experiment_id",
        F.col("_at").alias("idx"),
        _bin_start(F.col("_at") + F.col("_first_bin"), F.col("_anchor"), grid).alias("ts"),
        "n_points",
        *[F.when(F.col("_at") == F.col("idx"), names.col(f)).alias(f) for f in features],
    )


def resample_mean(
    readings: DataFrame,
    features: tuple[str, ...],
    grid: Grid,
    ranges: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Chunk means on the dense grid for every experiment within the length limits."""
    if grid.divides_day:
        binned = bin_readings(readings, features, grid, ranges)
        if fits_one_block(grid.max_rows):
            # one scan: chunk sums, then everything else by experiment
            return _filled(_gated_rows(binned, features, grid), None, features, grid)
        return dense_grid(binned, within_limits(extent_of_bins(binned, features, grid), grid), features, grid)
    extent = within_limits(experiment_extent(readings, grid), grid)
    return dense_grid(bin_readings(readings, features, grid, ranges, extent), extent, features, grid)


def align_channels(readings: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """One row per experiment and time with a column per feature, NULL where it has no point.

    n:<feature> counts the points; more than one marks a duplicate time.
    """
    picked = [
        c
        for f in features
        for c in (
            F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f),
            F.count(F.when(F.col("feature") == f, F.lit(1))).alias(f"n:{f}"),
        )
    ]
    return readings.groupBy("experiment_id", "ts").agg(*picked)


def _with_points(found: DataFrame, grid: Grid) -> DataFrame:
    minutes = F.expr("(last_us - first_us) div 60000000")
    if grid.chunk_seconds is not None:
        points = F.expr(f"minutes * 60 div {grid.chunk_seconds}")
    else:
        points = F.col("minutes") * grid.dps_per_minute
    return found.withColumn("minutes", minutes).withColumn("n_points", points)


def _anchor(grid: Grid) -> Column:
    """Where bins are counted from, in µs: the epoch if the raster allows it, else the first day."""
    if grid.divides_day:
        return F.lit(0).cast("long")
    return F.unix_micros(F.date_trunc("day", F.timestamp_micros("first_us")))


def _bin(offset_us: Column, grid: Grid) -> Column:
    # exact integer division: nanoseconds exceed the whole numbers a double can hold
    return F.call_function("div", offset_us * 1000, F.lit(grid.chunk_ns).cast("long"))


def _bin_start(number: Column, anchor_us: Column, grid: Grid) -> Column:
    start = F.call_function("div", number * grid.chunk_ns, F.lit(1000).cast("long"))
    return F.timestamp_micros(anchor_us + start)
