"""Feature names of the form device:channel."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorloom.settings import FEATURE_PATTERN, FIXED_FEATURE_PATTERN


def col(name: str) -> Column:
    """A column by its literal name; feature names hold ':' and '-'."""
    return F.col(f"`{name}`")


def is_feature(name: Column) -> Column:
    return name.rlike(FEATURE_PATTERN) | name.rlike(FIXED_FEATURE_PATTERN)


def device(name: Column) -> Column:
    return F.split_part(name, F.lit(":"), F.lit(1))


def channel(name: Column) -> Column:
    return F.split_part(name, F.lit(":"), F.lit(2))


def fixed_value(name: Column) -> Column:
    """The number in fix:NAME=VALUE, NULL for any other name."""
    number = F.split_part(name, F.lit("="), F.lit(2))
    return F.when(name.rlike(FIXED_FEATURE_PATTERN), number.try_cast("double"))


def parse(name: str) -> tuple[str, str]:
    """Device and channel of a feature named in a specification."""
    if not (re.match(FEATURE_PATTERN, name) or re.match(FIXED_FEATURE_PATTERN, name)):
        raise ValueError(f"not a feature name: {name!r}")
    dev, chan = name.split(":", 1)
    return dev, chan


def bin_limits(name: Column) -> tuple[Column, Column]:
    """Lower and upper size limit (µm) of a particle-count channel, from its name."""
    pair = r"(\d+)-(\d+)$"
    has_pair = name.rlike(pair)
    lower = (
        F.when(has_pair, F.regexp_extract(name, pair, 1).try_cast("double"))
        .when(name.endswith("_1000"), F.lit(1000.0))
        .otherwise(F.lit(0.0))
    )
    upper = (
        F.when(has_pair, F.regexp_extract(name, pair, 2).try_cast("double"))
        .when(name.endswith("_10"), F.lit(10.0))
        .when(name.endswith("_1000"), F.lit(1001.0))
        .otherwise(F.lit(0.0))
    )
    return lower, upper


def bin_limits_of(name: str) -> tuple[float, float]:
    """bin_limits of one name outside Spark."""
    pair = re.search(r"(\d+)-(\d+)$", name)
    if pair:
        return float(pair[1]), float(pair[2])
    if name.endswith("_1000"):
        return 1000.0, 1001.0
    return (0.0, 10.0) if name.endswith("_10") else (0.0, 0.0)
