"""Which features a data set needs, and the ones derived from others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions import names, physics, scaling
from sensorloom.operators.blocks import BLOCK, KEY, POS, Blocks
from sensorloom.session import keep
from sensorloom.settings import DERIVED_DEVICES, FEATURE_DEPENDENCIES

START_MINUTES = 10
# comparisons of means ignore differences that come from the order of summation
DIGITS = 12
MODES = ("minute_of_hour", "elapsed")


def required_features(*roles: tuple[str, ...]) -> list[str]:
    """Union of role lists in order, followed by what their derived features need."""
    wanted = list(dict.fromkeys(f for role in roles for f in role))
    for feature in wanted:
        names.parse(feature)
        device, _ = names.parse(feature)
        if device == "fe" and feature not in FEATURE_DEPENDENCIES:
            raise ValueError(f"unknown derived feature {feature!r}")
    needed = [d for f in wanted for d in FEATURE_DEPENDENCIES.get(f, ())]
    return list(dict.fromkeys([*wanted, *needed]))


def measured(features: list[str]) -> tuple[str, ...]:
    return tuple(f for f in features if names.parse(f)[0] not in DERIVED_DEVICES)


def dependency_table(spark) -> DataFrame:
    rows = [(f, r) for f, requires in FEATURE_DEPENDENCIES.items() for r in requires]
    return spark.createDataFrame(rows, "feature string, requires string")


def feature_set(roles: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Distinct channels per device over all roles and dependencies, from tables."""
    wanted = roles.select("feature").distinct()
    needed = wanted.join(dependencies, "feature").select(F.col("requires").alias("feature"))
    total = wanted.union(needed).distinct()
    return (
        total.where(names.is_feature(F.col("feature")))
        .groupBy(names.device(F.col("feature")).alias("device"))
        .agg(F.array_join(F.sort_array(F.collect_set(names.channel(F.col("feature")))), ",").alias("channels"))
    )


def parse_features(table: DataFrame, column: str = "feature") -> DataFrame:
    """Validity, device and channel of each name."""
    name = F.col(column)
    valid = names.is_feature(name)
    return table.select(
        "*",
        valid.alias("valid"),
        F.when(valid, names.device(name)).alias("device"),
        F.when(valid, names.channel(name)).alias("channel"),
    )


def fixed_feature(grid: DataFrame, feature: str) -> DataFrame:
    """A constant column for fix:NAME=VALUE."""
    _, channel = names.parse(feature)
    return grid.withColumn(feature, F.lit(float(channel.split("=")[1])))


def supersaturation_feature(
    grid: DataFrame, ranges: dict[str, tuple[float, float]], substance: Column, normalize: bool = False
) -> DataFrame:
    """fe:supersaturation from normalized concentration and temperature; the plain ratio by default."""
    concentration = scaling.denormalize(names.col("ftir:concentration"), *ranges["ftir:concentration"])
    temperature = scaling.denormalize(names.col("ftir:temperature"), *ranges["ftir:temperature"])
    ratio = physics.supersaturation(concentration, temperature, substance)
    if normalize:
        ratio = scaling.normalize(ratio, *ranges["fe:supersaturation"])
    return grid.withColumn("fe:supersaturation", ratio)


def nucleation_candidates(
    grid: DataFrame,
    feature: str = "sensor:intensity",
    mode: str = "minute_of_hour",
    max_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """The grid with rate, the smoothed slope of the intensity, and candidate, true on rising slopes.

    The slope is averaged over a tenth of the experiment; a candidate lies between a lower mean before
    and a higher mean after it, each over a fiftieth. These widths differ from experiment to
    experiment, so sums are differences of running sums. mode says which minutes at the start
    are passed over: the first ten of every hour, or of the experiment.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    blocks = Blocks(max_rows, block_rows)
    sums = _WholeSums() if blocks.whole else _BlockSums(blocks)
    x = names.col(feature)
    if blocks.whole:
        order = blocks.window()
        stepped = grid.withColumn("_step", x - F.lag(x).over(order))
        stepped = stepped.withColumn("_rows", F.count("*").over(Window.partitionBy(KEY)))
    else:
        order = blocks.window()
        stepped = blocks.own(blocks.spread(grid, 1, 0).withColumn("_step", x - F.lag(x).over(order)))
        lengths = grid.groupBy(KEY).agg(F.count("*").alias("_rows"))
        stepped = stepped.join(lengths, KEY)
    stepped = stepped.withColumn(
        "_step", F.when((F.col(POS) == 0) & x.isNotNull(), F.lit(0.0)).otherwise(F.col("_step"))
    )
    stepped = stepped.withColumn("_width", F.expr("_rows div 10")).withColumn("_near", F.expr("_rows div 50"))
    near = sums.of_means(
        stepped,
        "_step",
        {"rate": (F.expr("_width div 2"), F.expr("(_width - 1) div 2"))},
        {"_before": (F.col("_near"), None), "_after": (F.lit(0), F.col("_near") - 1)},
    )
    inside = (F.col("_near") >= 1) & (F.col(POS) > F.col("_near")) & (F.col(POS) < F.col("_rows") - F.col("_near"))
    rising = (F.round("_before", DIGITS) < F.col("rate")) & (F.col("rate") < F.round("_after", DIGITS)) & (F.col("rate") > 0.0)
    if mode == "minute_of_hour":
        late = F.minute("ts") >= START_MINUTES
    elif blocks.whole:
        late = _minutes(F.col("ts"), F.min("ts").over(Window.partitionBy(KEY))) >= START_MINUTES
    else:
        near = near.join(grid.groupBy(KEY).agg(F.min("ts").alias("_start")), KEY)
        late = _minutes(F.col("ts"), F.col("_start")) >= START_MINUTES
    return near.select(
        *[names.col(c) for c in grid.columns],
        "rate",
        F.coalesce(inside & rising & late, F.lit(False)).alias("candidate"),
    )


def nucleation_point(candidates: DataFrame) -> DataFrame:
    """Position of the steepest candidate, the earliest of equals (experiment_id, idx, ts, rate)."""
    key = F.struct(-F.col("rate"), F.col(POS))
    best = candidates.where("candidate").groupBy(KEY).agg(
        F.min_by(F.struct(POS, "ts", "rate"), key).alias("_best")
    )
    return best.select(KEY, "_best.*")


def nucleation_temperature(
    grid: DataFrame,
    mode: str = "minute_of_hour",
    max_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """fe:nucleation_temperature, the temperature at the nucleation point on every row.

    It is NULL for experiments without a nucleation point.
    """
    marked = nucleation_candidates(grid, mode=mode, max_rows=max_rows, block_rows=block_rows)
    key = F.when(F.col("candidate"), F.struct(-F.col("rate"), F.col(POS)))
    name = "fe:nucleation_temperature"
    if Blocks(max_rows, block_rows).whole:
        found = F.min_by(names.col("sensor:temperature"), key).over(Window.partitionBy(KEY))
        return marked.withColumn(name, found).drop("rate", "candidate")
    found = marked.groupBy(KEY).agg(F.min_by(names.col("sensor:temperature"), key).alias(name))
    return grid.join(found, KEY)


def _minutes(ts: Column, start: Column) -> Column:
    return (F.unix_micros(ts) - F.unix_micros(start)) / 60_000_000


class _WholeSums:
    """Means over frames of per-experiment width, with a whole experiment in one group.

    The group's rows come in the order and on the partitioning of the windows before them, so nothing is sorted or exchanged again; a mean is the
    difference of two running sums.
    """

    def of_means(self, grid: DataFrame, value: str, first: dict, then: dict) -> DataFrame:
        """A column for the one frame (before, after) of first, the rounded mean over rows [idx - before, idx + after], and one per frame of then, means of that column.

        With after None a frame ends at the row before.
        """
        frames = {n: (before, F.lit(-1) if after is None else after) for n, (before, after) in (first | then).items()}
        (middle,), others, kept = first, list(then), grid.columns
        widths = [c.cast("long").alias(f"{end}:{n}") for n, ends in frames.items() for end, c in zip(("before", "after"), ends)]

        def averages(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by(POS)

            def mean(x: np.ndarray, name: str) -> np.ndarray:
                known = ~np.isnan(x)
                total = np.concatenate(([0.0], np.cumsum(np.where(known, x, 0.0))))
                count = np.concatenate(([0], np.cumsum(known)))
                at = np.arange(len(x))
                front = np.clip(at - rows.column(f"before:{name}").to_numpy(), 0, len(x))
                end = np.clip(at + rows.column(f"after:{name}").to_numpy() + 1, front, len(x))
                n = count[end] - count[front]
                return np.where(n > 0, (total[end] - total[front]) / np.maximum(n, 1), np.nan)

            found = {middle: mean(rows.column(value).to_numpy(), middle)}
            rounded = np.round(found[middle], DIGITS)
            found |= {name: mean(rounded, name) for name in others}
            out = rows.select(kept)
            for name, x in found.items():
                out = out.append_column(name, pa.array(x, pa.float64(), mask=np.isnan(x)))
            return out

        schema = T.StructType([*grid.schema.fields, *[T.StructField(n, T.DoubleType()) for n in frames]])
        averaged = grid.select("*", *widths).groupBy(KEY).applyInArrow(averages, schema)
        return averaged.withColumn(middle, F.round(middle, DIGITS))


class _BlockSums:
    """The same means from running sums per block, with one exchange that brings each row its two ends."""

    def __init__(self, blocks: Blocks):
        self.blocks = blocks

    def of_means(self, grid: DataFrame, value: str, first: dict, then: dict) -> DataFrame:
        (middle,) = first
        return self.means(self.means(grid, value, first).withColumn(middle, F.round(middle, DIGITS)), middle, then)

    def means(self, grid: DataFrame, value: str, frames: dict) -> DataFrame:
        frames = {n: (before, F.lit(-1) if after is None else after) for n, (before, after) in frames.items()}
        # the rows are needed more than once below: go on from a stored table
        running = self._running(keep(grid, "sums"), value)
        own = F.struct(*[names.col(c) for c in running.columns if c not in (KEY, POS, "_sums")])
        # a row's sums are the end of the frame of the row 'after' before it, and lie in front of the
        # frame of the row 'before + 1' behind it
        sends = [F.struct(F.lit("self").alias("role"), F.col(POS).alias("to"))]
        for name, (before, after) in frames.items():
            sends.append(F.struct(F.lit(f"end:{name}").alias("role"), (F.col(POS) - after).alias("to")))
            sends.append(F.struct(F.lit(f"front:{name}").alias("role"), (F.col(POS) + before + 1).alias("to")))
        sent = running.select(KEY, "_sums", "_rows", own.alias("_own"), F.explode(F.array(*sends)).alias("_send"))
        sent = sent.where((F.col("_send.to") >= 0) & (F.col("_send.to") < F.col("_rows")))
        # only a row's own copy needs its columns; a position's few rows come from different blocks, so they are exchanged before they are grouped,
        # and a named number of partitions is kept as it is, where few large sorts would be merged from them
        own = F.when(F.col("_send.role") == "self", F.col("_own")).alias("_own")
        sent = sent.select(KEY, F.col("_send.to").alias(POS), F.col("_send.role").alias("_role"), "_sums", own)
        sent = sent.repartition(self._tasks(grid), KEY, POS)
        roles = [r for name in frames for r in (f"end:{name}", f"front:{name}")]

        def received(role: str, what: str) -> Column:
            return F.any_value(F.when(F.col("_role") == role, F.col(what)), ignoreNulls=True)

        met = sent.groupBy(KEY, POS).agg(
            received("self", "_own").alias("_own"), *[received(r, "_sums").alias(r) for r in roles]
        )
        rows = met.select(KEY, POS, "_own.*", *[names.col(r) for r in roles])
        averages = [self._mean(name, *ends).alias(name) for name, ends in frames.items()]
        return rows.select("*", *averages).drop("_all", *roles)

    def _tasks(self, grid: DataFrame) -> int:
        return int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def _mean(self, name: str, before: Column, after: Column) -> Column:
        # frames that run over the last row end there, frames before the first row are empty
        end = F.when(F.col(POS) + after >= 0, F.coalesce(names.col(f"end:{name}"), F.col("_all")))
        front = names.col(f"front:{name}")
        total = end["total"] - F.coalesce(front["total"], F.lit(0.0))
        count = end["known"] - F.coalesce(front["known"], F.lit(0))
        return total / F.when(count > 0, count)

    def _running(self, grid: DataFrame, value: str) -> DataFrame:
        grid = grid.withColumn(BLOCK, self.blocks.number())
        sums = grid.groupBy(KEY, BLOCK).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
        ordered = Window.partitionBy(KEY).orderBy(BLOCK)
        earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
        everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        carried = sums.select(
            KEY,
            BLOCK,
            F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s"),
            F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c"),
            F.struct(
                F.coalesce(F.sum("_s").over(everything), F.lit(0.0)).alias("total"),
                F.sum("_c").over(everything).alias("known"),
            ).alias("_all"),
        )
        order = self.blocks.window().rowsBetween(Window.unboundedPreceding, 0)
        inside = F.coalesce(F.sum(value).over(order), F.lit(0.0))
        return (
            grid.repartition(self._tasks(grid), KEY, BLOCK)
            .withColumn("_total", inside)
            .withColumn("_known", F.count(value).over(order))
            .join(carried, [KEY, BLOCK])
            .withColumn(
                "_sums",
                F.struct((F.col("_s") + F.col("_total")).alias("total"), (F.col("_c") + F.col("_known")).alias("known")),
            )
            .drop(BLOCK, "_s", "_c", "_total", "_known")
        )
