"""Windows, split, fit and errors; and the search over fit and window parameters."""

from __future__ import annotations

import itertools
import math
import random
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import epochs, forecast, gates, ordering, runs, windows
from sensorloom.session import keep
from sensorloom.settings import SPLIT_SEED, SWEEP_PARAMETERS, SWEEP_PLAIN_LISTS, SWEEP_SECTIONS, WindowSpec


@dataclass(frozen=True)
class Training:
    model: forecast.Forecaster
    metrics: DataFrame  # split, values, mse, mae
    rejects: DataFrame  # experiments that give no window


def training_windows(
    grid: DataFrame,
    spec: WindowSpec,
    validation_share: float = 0.2,
    seed: int = SPLIT_SEED,
    max_rows: int | None = None,
) -> DataFrame:
    """Windows of all experiments with their split."""
    split = ordering.group_split(grid.select("experiment_id"), validation_share, seed)
    return ordering.split_windows(windows.sliding_windows(grid, spec, max_rows), split)


def train(
    grid: DataFrame,
    spec: WindowSpec,
    ridge: float = 0.01,
    validation_share: float = 0.2,
    seed: int = SPLIT_SEED,
    max_rows: int | None = None,
) -> Training:
    """Fit on the training experiments; errors on both splits; experiments too short for a window as rejects."""
    grid = keep(grid, "grid")
    cut = training_windows(grid, spec, validation_share, seed, max_rows)
    model = forecast.fit(cut.where(F.col("split") == "train"), spec, ridge)
    metrics = forecast.forecast_metrics(forecast.predict(cut, model), ["split"])
    return Training(model, metrics, gates.too_short_for_windows(grid, spec.steps_history + spec.steps_prediction))


LOG = "epoch int, loss double, mse double, mae double, val_loss double, val_mse double, val_mae double"


@dataclass(frozen=True)
class EpochTraining:
    model: forecast.Forecaster
    log: DataFrame  # a row per epoch: loss and errors of its steps before they moved, and of the validation windows at its end
    rejects: DataFrame


def train_epochs(
    grid: DataFrame,
    spec: WindowSpec,
    nr_epochs: int,
    steps_per_epoch: int = 1,
    loss: str = "mse",
    optimizer: epochs.Descent | epochs.Adaptive | None = None,
    ridge: float = 0.0,
    stop: epochs.EarlyStop | None = None,
    validation_share: float = 0.2,
    seed: int = SPLIT_SEED,
    max_rows: int | None = None,
    shards: int = epochs.SHARDS,
) -> EpochTraining:
    """Fit by descent over nr_epochs passes, each in an order of its own; the model is that of the epoch with the least objective.

    The objective is val_loss, or loss where no window validates. Values that are not finite end the training.
    """
    grid = keep(grid, "grid")
    optimizer = optimizer or epochs.Descent()
    cut = training_windows(grid, spec, validation_share, seed, max_rows)
    stored = epochs.shard_windows(cut, seed, shards)
    learned, held = (stored.where(F.col("split") == part) for part in ("train", "validation"))
    shape = forecast.Shape.of(spec)
    weights = np.zeros((shape.inputs, shape.outputs))
    best, least, rows = weights, math.inf, []
    for epoch in range(nr_epochs):
        parts = []
        for chosen in epochs.dealt(epoch, steps_per_epoch, seed, shards):
            sums = epochs.batch_sums(learned.where(F.col(epochs.SHARD).isin(chosen)), spec, weights, loss)
            if sums.windows:
                parts.append(sums)
                weights = optimizer.move(weights, epochs.penalized(sums.gradient, weights, sums, ridge, shape))
        if not parts:
            raise ValueError("no complete window to fit on")
        checked = epochs.batch_sums(held, spec, weights, loss)
        # every step counts alike
        own = [float(np.mean([s.mean(getattr(s, name), shape) for s in parts])) for name in ("loss", "square", "absolute")]
        rows.append((epoch + 1, *own, *(checked.mean(getattr(checked, name), shape) for name in ("loss", "square", "absolute"))))
        objective = own[0] if checked.windows == 0 else rows[-1][4]
        if not math.isfinite(objective):
            break
        if objective < least:
            best, least = weights, objective
        if stop and stop.over(objective):
            break
    log = grid.sparkSession.createDataFrame(rows, LOG)
    rejects = gates.too_short_for_windows(grid, spec.steps_history + spec.steps_prediction)
    return EpochTraining(forecast.Forecaster(spec, best, ridge), log, rejects)


def suggestions(config: dict, trials: int, seed: int = SPLIT_SEED) -> list[dict]:
    """Seeded draws for every listed parameter: from a range for two ints or floats, else from the list."""
    draw = random.Random(seed)
    drawn = []
    for _ in range(trials):
        values = {}
        for section in SWEEP_SECTIONS:
            for key, choices in config.get(section, {}).items():
                if not _is_searched(key, choices):
                    continue
                values[key] = _draw(draw, choices)
        drawn.append(values)
    return drawn


def grid_suggestions(**choices: list) -> list[dict]:
    """Every combination of the given values."""
    return [dict(zip(choices, values)) for values in itertools.product(*choices.values())]


def param_sweep(
    grid: DataFrame,
    spec: WindowSpec,
    trials: list[dict],
    validation_share: float = 0.2,
    seed: int = SPLIT_SEED,
    max_rows: int | None = None,
) -> DataFrame:
    """One row per trial (trial, steps_history, steps_prediction, ridge, loss, val_loss, objective).

    Trials that differ in ridge only share one pass over the windows: fit and both losses come from the
    summed products of the two splits.
    """
    grid = keep(grid, "grid")
    split = keep(ordering.group_split(grid.select("experiment_id"), validation_share, seed), "split")
    sums = {}
    rows = []
    for number, values in enumerate(trials):
        shaped = replace(
            spec,
            steps_history=int(values.get("nr_timesteps_history", spec.steps_history)),
            steps_prediction=int(values.get("nr_timesteps_prediction", spec.steps_prediction)),
        )
        if shaped not in sums:
            cut = ordering.split_windows(windows.sliding_windows(grid, shaped, max_rows), split)
            sums[shaped] = forecast.as_matrices(forecast.gramian(cut, shaped, by="split"), "split", ("train", "validation"), forecast.Shape.of(shaped))
        ridge = float(values.get("ridge", 0.01))
        try:
            model = forecast.solve(sums[shaped]["train"], shaped, ridge)
            loss = forecast.squared_error(sums[shaped]["train"], model)
            val_loss = forecast.squared_error(sums[shaped]["validation"], model)
        except ValueError:  # no complete window of this shape
            loss = val_loss = None
        rows.append((number, shaped.steps_history, shaped.steps_prediction, ridge, loss, val_loss))
    table = grid.sparkSession.createDataFrame(
        rows, "trial int, steps_history int, steps_prediction int, ridge double, loss double, val_loss double"
    )
    return table.withColumn("objective", runs.objective(F.col("val_loss"), F.col("loss")))


def _is_searched(key: str, choices) -> bool:
    if key not in SWEEP_PARAMETERS or not isinstance(choices, list) or not choices:
        return False
    return key not in SWEEP_PLAIN_LISTS or all(isinstance(c, list) for c in choices)


def _draw(draw: random.Random, choices: list):
    if len(choices) == 2 and all(type(c) is int for c in choices):
        return draw.randint(min(choices), max(choices))
    if len(choices) == 2 and all(type(c) is float for c in choices):
        return draw.uniform(min(choices), max(choices))
    return draw.choice(choices)
