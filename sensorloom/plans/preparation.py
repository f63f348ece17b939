"""From raw readings to the prepared grid, as one plan for all experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import names, scaling
from sensorloom.operators import resample, series
from sensorloom.operators.features import measured, required_features
from sensorloom.operators.positions import number_rows
from sensorloom.settings import DatasetSpec, Grid


def grid_limit(spec: DatasetSpec) -> int | None:
    """Rows an experiment can have in a prepared grid; unknown without resampling."""
    return spec.grid.max_rows if spec.resample else None


def spec_features(spec: DatasetSpec) -> tuple[str, ...]:
    return measured(required_features(spec.history, spec.prediction, spec.controlled))


def preprocess(readings: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Prepared grid (experiment_id, idx, ts, n_points, <feature>...) of experiments within the limits.

    readings are (experiment_id, feature, ts, value) of the specification's measured features.
    """
    features = spec_features(spec)
    ranges = {f: spec.ranges[f] for f in features}
    limits = ranges if spec.remove_outliers else None
    if spec.resample:
        grid = resample.resample_mean(readings, features, spec.grid, limits)
    else:
        grid = _raw_grid(readings, features, spec.grid, limits)
    return condition(grid, spec)


def condition(grid: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Normalize, fill and smooth a grid as far as the specification asks for it."""
    features = spec_features(spec)
    limit = grid_limit(spec)
    if spec.normalize:
        grid = normalize_grid(grid, features, spec.ranges)
        grid = series.fill_gaps(grid, features, limit)
    if spec.smooth:
        grid = series.smooth_centered(grid, features, spec.smoothing, max_rows=limit)
    return grid


def normalize_grid(grid: DataFrame, features, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return _scaled(grid, features, ranges, scaling.normalize)


def denormalize_grid(grid: DataFrame, features, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return _scaled(grid, features, ranges, scaling.denormalize)


def _scaled(grid, features, ranges, scale):
    return grid.select(
        *[
            scale(names.col(c), *ranges[c]).alias(c) if c in features else names.col(c)
            for c in grid.columns
        ]
    )


def _raw_grid(readings: DataFrame, features, grid: Grid, limits) -> DataFrame:
    """Aligned rows as they are, numbered by time; hours keep the numbering distributed."""
    extent = resample.within_limits(resample.experiment_extent(readings, grid), grid)
    aligned = resample.align_channels(
        resample.null_outliers(readings, limits) if limits else readings, features
    )
    kept = aligned.join(extent.select("experiment_id", "n_points"), "experiment_id")
    numbered = number_rows(kept, ["experiment_id"], F.date_trunc("hour", "ts"), ["ts"], "idx")
    return numbered.select("experiment_id", "idx", "ts", "n_points", *[names.col(f) for f in features])
