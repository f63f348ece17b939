"""Raw readings: one row per measured point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions import names, scaling
from sensorloom.settings import (
    CHANNEL_ALIASES,
    DERIVED_DEVICES,
    EARLIEST_READING,
    SUBSTANCE_ALIASES,
)

READINGS = T.StructType(
    [
        T.StructField("experiment_id", T.LongType()),
        T.StructField("substance", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """The readings table; filters and column choices made on it reach the parquet scan."""
    return spark.read.schema(READINGS).parquet(path)


def is_channel(channel: str) -> Column:
    """The channel under its own name or its alias."""
    return F.col("channel").isin(*_with_alias(channel, CHANNEL_ALIASES))


def is_substance(substance: str) -> Column:
    return F.col("substance").isin(*_with_alias(substance, SUBSTANCE_ALIASES))


def scan(
    readings: DataFrame,
    experiment_id: int | None = None,
    device: str | None = None,
    channel: str | None = None,
    substance: str | None = None,
    since=EARLIEST_READING,
) -> DataFrame:
    """Points of an experiment, device, channel and substance as (experiment_id, feature, ts, value)."""
    wanted = F.col("ts") >= F.lit(since)
    if experiment_id is not None:
        wanted &= F.col("experiment_id") == experiment_id
    if device is not None:
        wanted &= F.col("device") == device
    if channel is not None:
        wanted &= is_channel(channel)
    if substance is not None:
        wanted &= is_substance(substance)
    return readings.where(wanted).select("experiment_id", _feature().alias("feature"), "ts", _value())


def scan_features(
    readings: DataFrame, features: list[str], substance: str | None = None, since=EARLIEST_READING
) -> DataFrame:
    """Points of all measured features in the list, for all experiments.

    The list comes from a specification, so it is written into the filter, where the scan can
    use it, rather than joined.
    """
    measured = [f for f in features if names.parse(f)[0] not in DERIVED_DEVICES]
    if not measured:
        raise ValueError("no measured feature in the list")
    wanted = reduce(lambda a, b: a | b, [_is_feature(f) for f in measured])
    if substance is not None:
        wanted &= is_substance(substance)
    return readings.where((F.col("ts") >= F.lit(since)) & wanted).select(
        "experiment_id", _feature().alias("feature"), "ts", _value()
    )


def _is_feature(feature: str) -> Column:
    device, channel = names.parse(feature)
    return (F.col("device") == device) & is_channel(channel)


def _with_alias(name: str, aliases: dict[str, str]) -> list[str]:
    return [name, aliases[name]] if name in aliases else [name]


def _feature() -> Column:
    """device:channel with alias spellings put back to the short name."""
    channel = F.col("channel")
    for short, alias in CHANNEL_ALIASES.items():
        channel = F.when(F.col("channel") == alias, F.lit(short)).otherwise(channel)
    return F.concat_ws(":", F.col("device"), channel)


def _value() -> Column:
    return scaling.not_nan(F.col("value")).alias("value")
