"""The whole data-set job: scan, gates, grid, derived features, and the size of the set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import names
from sensorloom.operators import augment, cluster, curves, features, gates, resample
from sensorloom.plans.preparation import condition, grid_limit, preprocess, spec_features
from sensorloom.session import keep
from sensorloom.settings import DatasetSpec
from sensorloom.sources import dataset as storage
from sensorloom.sources.readings import scan_features


@dataclass(frozen=True)
class Dataset:
    grid: DataFrame
    rejects: DataFrame
    action: str  # keep, augment or cluster
    selection: cluster.Selection | None = None


def prepare(
    readings: DataFrame,
    spec: DatasetSpec,
    experiments: DataFrame | None = None,
    substance: Column | None = None,
    check_duplicates: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Prepared grid with derived features, and the rejects with their reasons.

    Raw readings are summed up per chunk once and the sums stored in the shared folder; extents, gates
    and grid are taken from there. The search for duplicate times is the one step that has to exchange
    the raw rows.
    """
    wanted = features.required_features(spec.history, spec.prediction, spec.controlled)
    measured = spec_features(spec)
    points = scan_features(readings, wanted, spec.substance)
    if experiments is not None:
        points = points.join(experiments.select("experiment_id"), "experiment_id", "left_semi")
    unranged = [f for f in measured if f not in spec.ranges]

    found = []
    if spec.resample and spec.grid.divides_day and not unranged:
        limits = {f: spec.ranges[f] for f in measured} if spec.remove_outliers else None
        binned = keep(resample.bin_readings(points, measured, spec.grid, limits), "bins")
        extent = keep(resample.extent_of_bins(binned, measured, spec.grid), "extent")
    else:
        binned = None
        extent = keep(resample.experiment_extent(points, spec.grid, measured), "extent")
    if experiments is not None:
        found.append(gates.absent(experiments, extent))
    found.append(gates.incomplete(extent, measured))
    if check_duplicates:
        found.append(gates.duplicated_readings(points))
    found.append(gates.out_of_limits(extent, spec.grid))
    if unranged:
        found.append(
            extent.select("experiment_id", F.lit("preprocess").alias("stage"), F.lit(f"no range for {unranged[0]}").alias("reason"))
        )
    rejects = keep(gates.first_rejects(*found), "rejects")
    if unranged:
        empty = extent.where(F.lit(False)).select(
            "experiment_id", *[F.lit(None).cast("double").alias(f) for f in wanted]
        )
        return empty, rejects

    accepted = gates.accept(extent, rejects)
    if binned is not None:
        grid = condition(resample.dense_grid(binned, accepted, measured, spec.grid), spec)
    else:
        grid = preprocess(gates.accept(points, rejects), spec)
    grid, failed = derive(grid, wanted, spec, substance)
    if failed is not None:
        rejects = rejects.unionByName(failed)
    return grid, rejects


def derive(
    grid: DataFrame, wanted: list[str], spec: DatasetSpec, substance: Column | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Fixed and engineered features; experiments without a nucleation point come back as rejects."""
    failed = None
    for feature in wanted:
        device, _ = names.parse(feature)
        if device == "fix":
            grid = features.fixed_feature(grid, feature)
        elif feature == "fe:supersaturation":
            column = substance if substance is not None else F.lit(spec.substance)
            grid = features.supersaturation_feature(grid, spec.ranges, column)
        elif feature == "fe:nucleation_temperature":
            grid = keep(
                features.nucleation_temperature(grid, spec.nucleation_start, grid_limit(spec)), "nucleation"
            )
            point = names.col(feature)
            failed = (
                grid.groupBy("experiment_id").agg(F.count(point).alias("n")).where(F.col("n") == 0)
                .select(
                    "experiment_id", F.lit("features").alias("stage"), F.lit("no nucleation point").alias("reason")
                )
            )
            grid = grid.where(point.isNotNull())
    return grid, failed


def generate_dataset(
    readings: DataFrame,
    spec: DatasetSpec,
    experiments: DataFrame | None = None,
    substance: Column | None = None,
    check_duplicates: bool = True,
) -> Dataset:
    """Prepare all experiments, then enlarge the set by jitter or cut it to cluster representatives."""
    grid, rejects = prepare(readings, spec, experiments, substance, check_duplicates)
    grid = keep(grid, "grid")
    count = grid.select("experiment_id").distinct().count()
    action, amount = curves.resize_plan(count, spec.min_experiments, spec.max_experiments, spec.clusters)
    if action == "augment" and count:
        columns = tuple(c for c in grid.columns if ":" in c)
        samples = augment.jitter(grid, columns, amount, spec.smoothing, spec.jitter, spec.seed, grid_limit(spec))
        return Dataset(augment.with_samples(grid, samples), rejects, action)
    if action == "cluster":
        selection = cluster.cluster_select(grid, spec.clusters, amount, seed=spec.seed, max_rows=grid_limit(spec))
        feature = names.col(curves.cluster_feature(grid.columns))
        gaps = (
            grid.groupBy("experiment_id").agg(F.count_if(feature.isNull()).alias("n")).where(F.col("n") > 0)
            .select("experiment_id", F.lit("cluster").alias("stage"), F.lit("missing values in the curve").alias("reason"))
        )
        rejects = gates.first_rejects(rejects, gaps)
        chosen = curves.select_experiments(grid, selection.members)
        return Dataset(chosen, rejects, action, selection)
    return Dataset(grid, rejects, "keep")


def save(dataset: Dataset, path: str) -> None:
    """Grid, experiment list, rejects and, after clustering, the chosen members and the mean silhouette."""
    storage.write_dataset(dataset.grid, f"{path}/grid")
    storage.write_experiment_list(dataset.grid, f"{path}/experiments")
    dataset.rejects.write.mode("overwrite").parquet(f"{path}/rejects")
    if dataset.selection is not None:
        storage.write_json(dataset.selection.members, f"{path}/top_experiments")
        score = cluster.mean_silhouette(dataset.selection.silhouette)
        storage.write_json(score, f"{path}/silhouette")
