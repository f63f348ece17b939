"""Particle-size operators: count bins, size distributions and kinetics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import names, physics
from sensorloom.settings import GROWTH, NUCLEATION

SPHERE = math.pi / 6.0 * 1e-18  # m^3 per cubed µm of diameter
ROWS_AT_ONCE = 512


def bin_percentages(grid: DataFrame, bins: tuple[str, ...]) -> DataFrame:
    """Share of each bin in the row's total count; 0 where the total is not positive."""
    total = _total(bins)
    return grid.select(
        *[names.col(c) for c in grid.columns if c not in bins],
        *[F.when(total <= 0.0, F.lit(0.0)).otherwise(names.col(b) / F.when(total > 0.0, total)).alias(b) for b in bins],
        total.alias("total_count"),
    )


def bin_moments(grid: DataFrame, bins: tuple[str, ...]) -> DataFrame:
    """Mean size, spread of the weighted bin centres, and the weighted standard deviation."""
    mean, spread, deviation = _moments(bins)
    return grid.select(
        "experiment_id", "idx", mean.alias("mean_size"), spread.alias("spread_ref"), deviation.alias("weighted_std")
    )


def csd_arrays(
    grid: DataFrame, bins: tuple[str, ...], mass_total: Column, density: Column, step: float = 0.1, l_max: float = 300.0
) -> DataFrame:
    """A normal size distribution per row with the bins' mean and spread and a given total mass: (experiment_id, t, f), f an array over sizes(step, l_max).

    Each row stays one row. One without counts, without spread or mass, or so narrow that it misses every size has NULL as f.
    """
    mean, spread, _ = _moments(bins)
    at = sizes(step, l_max)
    volumes = at**3 * SPHERE

    def spread_out(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                middle, width, volume = (part.column(k).to_numpy(zero_copy_only=False)[:, None] for k in (2, 3, 4))
                # the density's constant factors and its sum to 1 cancel against the given mass
                with np.errstate(divide="ignore", invalid="ignore"):
                    off = (at[None, :] - middle) / np.where(width > 0.0, width, np.nan)
                    shape = np.exp(-0.5 * off * off)
                    total = shape @ volumes
                    f = shape * (volume[:, 0] / np.where(total > 0.0, total, np.nan))[:, None]
                missing = np.isnan(f[:, 0])
                values = pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), len(at)).cast(pa.list_(pa.float64()))
                values = pc.if_else(pa.array(missing), pa.scalar(None, values.type), values)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), values], ["experiment_id", "t", "f"])

    rows = grid.select(
        "experiment_id",
        F.col("idx").cast("double").alias("t"),
        mean.cast("double").alias("_mean"),
        spread.cast("double").alias("_spread"),
        (mass_total / density).cast("double").alias("_volume"),
    )
    kind = grid.schema["experiment_id"].dataType.simpleString()
    return rows.mapInArrow(spread_out, f"experiment_id {kind}, t double, f array<double>")


def sizes(step: float, l_max: float) -> np.ndarray:
    """The sizes of a distribution, from 0 to l_max."""
    count = int(l_max / step)
    return np.arange(count) * (l_max / (count - 1))


def csd_from_bins(
    grid: DataFrame, bins: tuple[str, ...], mass_total: Column, density: Column, step: float = 0.1, l_max: float = 300.0
) -> DataFrame:
    """csd_arrays with a row for every size: (experiment_id, t, l, f)."""
    count = len(sizes(step, l_max))
    arrays = csd_arrays(grid, bins, mass_total, density, step, l_max)
    every = arrays.select("experiment_id", "t", "f", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_n"))
    size = F.col("_n").cast("double") * F.lit(l_max / (count - 1))
    return every.select("experiment_id", "t", size.alias("l"), F.get("f", F.col("_n")).alias("f"))


def _weighted_sums(arrays: DataFrame, weights: np.ndarray, columns: list[str]) -> DataFrame:
    """(experiment_id, t, <column>...): each distribution's sum with each row of weights, without an exchange; NULL where f is."""

    def sums(batches):
        for batch in batches:
            known = batch.column(2).is_valid()
            found = np.full((batch.num_rows, len(columns)), np.nan)
            f = batch.column(2).filter(known).flatten().to_numpy(zero_copy_only=False).reshape(-1, weights.shape[1])
            found[known.to_numpy(zero_copy_only=False)] = f @ weights.T
            values = [pa.array(found[:, k], from_pandas=True) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], ["experiment_id", "t", *columns])

    kind = arrays.schema["experiment_id"].dataType.simpleString()
    schema = ", ".join([f"experiment_id {kind}", "t double", *(f"`{c}` double" for c in columns)])
    return arrays.select("experiment_id", "t", "f").mapInArrow(sums, schema)


def arrays_to_bins(
    arrays: DataFrame, bins: tuple[str, ...], percentage: bool = True, step: float = 0.1, l_max: float = 300.0
) -> DataFrame:
    """As csd_to_bins, from csd_arrays."""
    at = sizes(step, l_max)
    limits = [names.bin_limits_of(b) for b in bins]
    weights = np.array([*((at >= lo) & (at < hi) for lo, hi in limits), np.ones(len(at), bool)], float)
    total = _weighted_sums(arrays, weights, [*bins, "_total"])
    return _shares(total, bins) if percentage else total.drop("_total")


def array_moments(arrays: DataFrame, density: Column, step: float = 0.1, l_max: float = 300.0) -> DataFrame:
    """As csd_moments, from csd_arrays."""
    at = sizes(step, l_max)
    weights = np.array([4.0 * math.pi * (at / 2.0) ** 2 * 1e-12, at**3 * SPHERE])
    return _weighted_sums(arrays, weights, ["surface", "volume"]).withColumn("mass", F.col("volume") * density)


def csd_to_bins(csd: DataFrame, bins: tuple[str, ...], percentage: bool = True) -> DataFrame:
    """Amount per bin (experiment_id, t, <bin>...), lower limit inside, upper one outside."""
    sums = []
    for b in bins:
        lo, hi = names.bin_limits(F.lit(b))
        sums.append(F.sum(F.when((F.col("l") >= lo) & (F.col("l") < hi), F.col("f")).otherwise(0.0)).alias(b))
    total = csd.groupBy("experiment_id", "t").agg(*sums, F.sum("f").alias("_total"))
    if not percentage:
        return total.drop("_total")
    return _shares(total, bins)


def _shares(total: DataFrame, bins: tuple[str, ...]) -> DataFrame:
    return total.select(
        "experiment_id",
        "t",
        *[
            F.when(F.col("_total") <= 0.0, F.lit(0.0))
            .otherwise(names.col(b) / F.when(F.col("_total") > 0.0, F.col("_total")))
            .alias(b)
            for b in bins
        ],
    )


def csd_moments(csd: DataFrame, density: Column) -> DataFrame:
    """Total surface (m^2), volume (m^3) and mass of each distribution, diameters in µm.

    density may be a constant or depend on the keys.
    """
    surface = F.col("f") * 4.0 * math.pi * (F.col("l") / 2.0) * (F.col("l") / 2.0) * 1e-12
    return (
        csd.groupBy("experiment_id", "t")
        .agg(F.sum(surface).alias("surface"), F.sum(F.col("f") * _sphere_volume(F.col("l"))).alias("volume"))
        .withColumn("mass", F.col("volume") * density)
    )


def size_index(size: Column, step: float) -> Column:
    """Grid index of a size; halves go to the even index."""
    return F.bround(size / F.lit(step)).cast("long")


def index_size(index: Column, step: float) -> Column:
    return index.cast("double") * F.lit(step)


def kinetics(
    grid: DataFrame,
    concentration: Column,
    temperature: Column,
    substance: Column,
    nucleation: tuple[float, float] = NUCLEATION,
    growth: tuple[float, float] = GROWTH,
    sizes: tuple[float, ...] = (10.0, 50.0, 150.0),
) -> DataFrame:
    """Saturation, ratio, nucleation and growth rates and suspended mass per row.

    Size-dependent growth comes as one column per size: growth_at_<size>.
    """
    j1, j2 = (F.lit(float(k)) for k in nucleation)
    g1, g2 = (F.lit(float(k)) for k in growth)
    limit = physics.saturation(temperature, substance)
    ratio = physics.supersaturation(concentration, temperature, substance)
    return grid.select(
        "*",
        limit.alias("saturation"),
        ratio.alias("supersaturation"),
        physics.nucleation_rate(ratio, j1, j2).alias("nucleation_rate"),
        physics.growth_rate(concentration, limit, g1, g2).alias("growth_rate"),
        *[
            physics.growth_rate_by_size(F.lit(float(l)), concentration, limit, g1, g2).alias(f"growth_at_{l:g}")
            for l in sizes
        ],
        physics.suspended_mass(concentration, substance).alias("suspended_mass"),
    )


def _total(bins: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [names.col(b) for b in bins])


def _moments(bins: tuple[str, ...]) -> tuple[Column, Column, Column]:
    total = _total(bins)
    share = [names.col(b) / F.when(total > 0.0, total) for b in bins]
    centre = [(lo + hi) / 2.0 for lo, hi in (names.bin_limits(F.lit(b)) for b in bins)]
    products = [w * c for w, c in zip(share, centre)]
    mean = reduce(lambda a, b: a + b, products)
    middle = mean / len(bins)
    spread = F.sqrt(reduce(lambda a, b: a + b, [(p - middle) * (p - middle) for p in products]) / len(bins))
    weighted = F.sqrt(reduce(lambda a, b: a + b, [w * (c - mean) * (c - mean) for w, c in zip(share, centre)]))
    return mean, spread, weighted


def _sphere_volume(diameter: Column) -> Column:
    return diameter * diameter * diameter * SPHERE
