"""Solubility, supersaturation and crystallization kinetics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorloom.settings import (
    ADIPIC_ACID_CURVE,
    ADIPIC_ACID_NAMES,
    DEFAULT_SUBSTANCE,
    DENSITIES,
    DISSOLVED_CONCENTRATION_OTHER,
    DISSOLVED_CONCENTRATIONS,
    GROWTH_BY_SIZE,
    KELVIN,
    POTASSIUM_PHOSPHATE_CURVE,
    POTASSIUM_PHOSPHATE_NAMES,
    REACTOR_VOLUME,
)


def saturation(temperature: Column, substance: Column) -> Column:
    """Saturation concentration in g per kg water at a temperature in °C; NULL if unknown."""
    kelvin = temperature + F.lit(KELVIN)
    base, slope = (F.lit(v) for v in ADIPIC_ACID_CURVE)
    acid = base * F.exp(slope * temperature)
    square, linear, constant, unit = (F.lit(v) for v in POTASSIUM_PHOSPHATE_CURVE)
    phosphate = (square * kelvin * kelvin - linear * kelvin + constant) * unit
    return F.when(substance.isin(*ADIPIC_ACID_NAMES), acid).when(
        substance.isin(*POTASSIUM_PHOSPHATE_NAMES), phosphate
    )


def supersaturation(concentration: Column, temperature: Column, substance: Column) -> Column:
    limit = saturation(temperature, substance)
    return F.when(limit != 0.0, concentration / limit)


def clamp(value: Column) -> Column:
    """Negative values become 0; NULL stays NULL."""
    return F.when(value < 0.0, F.lit(0.0)).otherwise(value)


def nucleation_rate(ratio: Column, k1: Column, k2: Column) -> Column:
    """Rate at a supersaturation ratio; its limit 0 at ratio 1, NULL where undefined."""
    log_ratio = F.when(ratio > 0.0, F.log(ratio))
    return (
        F.when(ratio <= 0.0, None)
        .when(ratio == 1.0, F.lit(0.0))
        .otherwise(k1 * ratio * F.exp(-k2 / (log_ratio * log_ratio)))
    )


def growth_rate(concentration: Column, limit: Column, k1: Column, k2: Column) -> Column:
    """Size-independent growth; NULL where the power has no real value."""
    power = F.pow(concentration - limit, k2)
    return k1 * F.when(~F.isnan(power), power)


def growth_rate_by_size(
    size: Column, concentration: Column, limit: Column, k1: Column, k2: Column
) -> Column:
    excess = clamp((concentration - limit) / limit)
    return k1 * F.pow(excess, k2) * (F.lit(1.0) + F.lit(GROWTH_BY_SIZE) * size)


def suspended_mass(concentration: Column, substance: Column) -> Column:
    """Crystal mass in the reactor (g) that is not dissolved."""
    dissolved = F.lit(DISSOLVED_CONCENTRATION_OTHER)
    for name, value in DISSOLVED_CONCENTRATIONS.items():
        dissolved = F.when(substance == name, F.lit(value)).otherwise(dissolved)
    return clamp((dissolved - concentration) * F.lit(REACTOR_VOLUME))


def substance_or_default(substance: Column) -> Column:
    return F.when(F.length(substance) > 0, substance).otherwise(F.lit(DEFAULT_SUBSTANCE))


def density(substance: Column) -> Column:
    """kg/dm^3, NULL for substances without a known density."""
    value = F.lit(None).cast("double")
    for name, known in DENSITIES.items():
        value = F.when(substance == name, F.lit(known)).otherwise(value)
    return value
