"""Training by epochs: descent steps whose loss and gradient Spark sums over all windows of a batch.

Windows are stored once in SHARDS folders, each window in the folder its digest names. An epoch puts the folders in a seeded order of its own and deals
them out into steps, so every window is read once an epoch, a step reads its own folders only, and no window is shuffled or numbered for it.
Every task adds up the loss, the errors and the gradient of its windows; their number depends on the window spec alone. Only these sums are exchanged,
and the weights go back to the tasks with the next step.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.hashing import digest
from sensorloom.operators.forecast import Shape, entries
from sensorloom.operators.windows import KEY, complete
from sensorloom.session import keep
from sensorloom.settings import SPLIT_SEED, WindowSpec

SHARDS = 16
SHARD = "shard"

# error -> (loss, slope) of one value
LOSSES = {
    "mse": lambda e: (e * e, 2.0 * e),
    "mae": lambda e: (np.abs(e), np.sign(e)),
    "huber": lambda e: (np.where(np.abs(e) <= 1.0, 0.5 * e * e, np.abs(e) - 0.5), np.clip(e, -1.0, 1.0)),
}


def shard_windows(windows: DataFrame, seed: int = SPLIT_SEED, shards: int = SHARDS) -> DataFrame:
    """Complete windows stored by shard. Without an exchange: every task writes its own part of each folder."""
    number = F.conv(F.substring(digest(F.col(KEY), F.col("j"), seed), 1, 8), 16, 10).cast("long") % shards
    return keep(complete(windows).withColumn(SHARD, number.cast("int")), "shards", partition_by=(SHARD,))


def dealt(epoch: int, steps: int, seed: int = SPLIT_SEED, shards: int = SHARDS) -> list[list[int]]:
    """The shards of each step of an epoch: ordered by the digest of shard, seed and epoch, and cut into `steps` even parts."""
    if not 1 <= steps <= shards:
        raise ValueError(f"steps must lie in 1..{shards}, got {steps}")
    order = sorted(range(shards), key=lambda s: (hashlib.md5(f"{s}|{seed}|{epoch}".encode()).hexdigest(), s))
    return [[s for place, s in enumerate(order) if place * steps // shards == step] for step in range(steps)]


@dataclass(frozen=True)
class Sums:
    """Summed over the values of all labels of a set of windows."""

    windows: int
    loss: float
    square: float
    absolute: float
    gradient: np.ndarray  # inputs x outputs

    def mean(self, total: float, shape: Shape) -> float | None:
        return total / (self.windows * shape.outputs) if self.windows else None


def batch_sums(windows: DataFrame, spec: WindowSpec, weights: np.ndarray, loss: str = "mse") -> Sums:
    """One pass over complete windows at the given weights."""
    shape = Shape.of(spec)
    value_and_slope = LOSSES[loss]

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = entries(batch, with_label=True)
            x, y = z[:, : shape.inputs], z[:, shape.inputs :]
            error = x @ weights - y
            value, slope = value_and_slope(error)
            part = np.r_[len(z), value.sum(), (error * error).sum(), np.abs(error).sum(), (x.T @ slope).ravel()]
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    parts = windows.select("history", "controlled", "label").mapInArrow(run, "at bigint, value double")
    sums = np.zeros(4 + shape.inputs * shape.outputs)
    for row in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        sums[row["at"]] = row["value"]
    return Sums(round(sums[0]), float(sums[1]), float(sums[2]), float(sums[3]), sums[4:].reshape(shape.inputs, shape.outputs))


@dataclass
class Descent:
    """Gradient steps with momentum."""

    rate: float = 0.1
    momentum: float = 0.0
    velocity: np.ndarray | float = field(default=0.0, repr=False)

    def move(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.velocity = self.momentum * self.velocity - self.rate * gradient
        return weights + self.velocity


@dataclass
class Adaptive:
    """Steps scaled by running means of the gradient and its square."""

    rate: float = 0.001
    first_decay: float = 0.9
    second_decay: float = 0.999
    tiny: float = 1e-7
    count: int = 0
    first: np.ndarray | float = field(default=0.0, repr=False)
    second: np.ndarray | float = field(default=0.0, repr=False)

    def move(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.count += 1
        self.first = self.first_decay * self.first + (1 - self.first_decay) * gradient
        self.second = self.second_decay * self.second + (1 - self.second_decay) * gradient * gradient
        first = self.first / (1 - self.first_decay**self.count)
        second = self.second / (1 - self.second_decay**self.count)
        return weights - self.rate * first / (np.sqrt(second) + self.tiny)


@dataclass
class EarlyStop:
    """Stop after `patience` epochs without an objective lower than the best by more than least_gain."""

    patience: int
    least_gain: float = 0.0
    best: float = float("inf")
    waited: int = 0

    def over(self, objective: float) -> bool:
        if objective < self.best - self.least_gain:
            self.best, self.waited = objective, 0
        else:
            self.waited += 1
        return self.waited >= self.patience


def penalized(gradient: np.ndarray, weights: np.ndarray, sums: Sums, ridge: float, shape: Shape) -> np.ndarray:
    """Mean gradient per value with the pull of the penalty, from which the constant is spared; its zero is the ridge solution."""
    pull = 2.0 * ridge * weights / shape.outputs
    pull[-1] = 0.0
    return gradient / (sums.windows * shape.outputs) + pull
