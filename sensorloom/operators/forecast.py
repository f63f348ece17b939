"""A linear multi-step forecaster over windows: fit, predict, errors, report.

The fit is a ridge regression from a window's flattened history and controlled part to its label. All
it needs is one matrix of summed products, which is built in a single pass over the windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import names
from sensorloom.operators.windows import complete, prediction_timeline
from sensorloom.settings import WindowSpec


@dataclass(frozen=True)
class Shape:
    inputs: int
    outputs: int

    @staticmethod
    def of(spec: WindowSpec) -> "Shape":
        inputs = spec.steps_history * len(spec.history) + spec.steps_prediction * len(spec.controlled) + 1
        return Shape(inputs, spec.steps_prediction * len(spec.prediction))

    @property
    def size(self) -> int:
        return self.inputs + self.outputs


@dataclass(frozen=True)
class Forecaster:
    spec: WindowSpec
    weights: np.ndarray  # inputs x outputs
    ridge: float


def gramian(windows: DataFrame, spec: WindowSpec, by: str | None = None) -> DataFrame:
    """Sums of products of all pairs of window entries (row, col, value), upper half, per group.

    Entries are the flattened history, the flattened controlled part, 1, and the flattened label;
    windows with a missing value are left out.
    """
    shape = Shape.of(spec)
    parts = complete(windows).select(
        *([F.col(by)] if by else []), "history", "controlled", "label"
    )

    def products(batches):
        sums = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = entries(batch, with_label=True)
            groups = np.array(batch.column(by).to_pylist()) if by else np.zeros(len(z), dtype=int)
            for group in np.unique(groups):
                part = z[groups == group]
                total = sums.setdefault(group, np.zeros((shape.size, shape.size)))
                total += part.T @ part
        upper = np.triu_indices(shape.size)
        for group, total in sums.items():
            columns = {"row": pa.array(upper[0], pa.int32()), "col": pa.array(upper[1], pa.int32()), "value": total[upper]}
            if by:
                columns = {by: pa.array([str(group)] * len(upper[0])), **columns}
            yield pa.RecordBatch.from_pydict(columns)

    keys = [by] if by else []
    prefix = f"{by} string, " if by else ""
    return (
        parts.mapInArrow(products, prefix + "row int, col int, value double")
        .groupBy(*keys, "row", "col")
        .agg(F.sum("value").alias("value"))
    )


def as_matrix(sums: DataFrame, shape: Shape) -> np.ndarray:
    """The whole symmetric matrix on the driver; its size depends on the window spec only."""
    return as_matrices(sums.withColumn("_group", F.lit("all")), "_group", ("all",), shape)["all"]


def as_matrices(sums: DataFrame, by: str, groups: tuple[str, ...], shape: Shape) -> dict[str, np.ndarray]:
    """The matrix of each named group, all in one pass; a group without rows has zeros."""
    matrices = {group: np.zeros((shape.size, shape.size)) for group in groups}
    for row in sums.where(F.col(by).isin(*groups)).select(F.col(by).alias("group"), "row", "col", "value").collect():
        matrix = matrices[row.group]
        matrix[row.row, row.col] = matrix[row.col, row.row] = row.value
    return matrices


def solve(matrix: np.ndarray, spec: WindowSpec, ridge: float) -> Forecaster:
    """Weights with the least mean squared error plus ridge times their squares; no penalty on the constant."""
    shape = Shape.of(spec)
    count = matrix[shape.inputs - 1, shape.inputs - 1]
    if count < 1:
        raise ValueError("no complete window to fit on")
    inner = matrix[: shape.inputs, : shape.inputs] / count
    cross = matrix[: shape.inputs, shape.inputs :] / count
    penalty = np.full(shape.inputs, float(ridge))
    penalty[-1] = 0.0
    weights, *_ = np.linalg.lstsq(inner + np.diag(penalty), cross, rcond=None)
    return Forecaster(spec, weights, ridge)


def fit(windows: DataFrame, spec: WindowSpec, ridge: float = 0.01) -> Forecaster:
    return solve(as_matrix(gramian(windows, spec), Shape.of(spec)), spec, ridge)


def squared_error(matrix: np.ndarray, model: Forecaster) -> float | None:
    """Mean squared error of a model on the windows a matrix was summed over, without a pass over them."""
    shape = Shape.of(model.spec)
    count = matrix[shape.inputs - 1, shape.inputs - 1]
    if count < 1:
        return None
    inner = matrix[: shape.inputs, : shape.inputs]
    cross = matrix[: shape.inputs, shape.inputs :]
    labels = np.trace(matrix[shape.inputs :, shape.inputs :])
    total = labels - 2.0 * np.sum(model.weights * cross) + np.sum(model.weights * (inner @ model.weights))
    return float(max(total, 0.0) / (count * shape.outputs))


def coefficients(spark, model: Forecaster) -> DataFrame:
    """The weights as a table (input, output, weight)."""
    rows = [
        (int(i), int(o), float(model.weights[i, o]))
        for i in range(model.weights.shape[0])
        for o in range(model.weights.shape[1])
    ]
    return spark.createDataFrame(rows, "input int, output int, weight double")


def predict(windows: DataFrame, model: Forecaster) -> DataFrame:
    """Windows with prediction, an array of P rows of the predicted features; missing inputs give NULL."""
    spec = model.spec
    weights = model.weights
    steps, width = spec.steps_prediction, len(spec.prediction)
    kept = [c for c in windows.columns if c not in ("history", "controlled")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema if f.name in kept)

    def forecast(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = entries(batch, with_label=False) @ weights
            flat = pa.array(y.ravel().astype(np.float32), from_pandas=True)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, width), pa.int32()), flat)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.shape[0] * steps + 1, steps), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], [*kept, "prediction"])

    return windows.select(*kept, "history", "controlled").mapInArrow(
        forecast, schema + ", prediction array<array<float>>"
    )


def persistence(windows: DataFrame, spec: WindowSpec) -> DataFrame:
    """Windows with the last history row carried on as prediction; a yardstick for errors."""
    last = F.element_at("history", -1)
    row = F.array(*[last[spec.history.index(f)] for f in spec.prediction])
    return windows.withColumn("prediction", F.array_repeat(row, spec.steps_prediction))


def forecast_metrics(predicted: DataFrame, by: list[str | Column] | None = None) -> DataFrame:
    """Mean squared and mean absolute error over all steps and features, and how many values they cover."""
    off = F.filter(
        F.zip_with(
            F.flatten("label"), F.flatten("prediction"), lambda y, p: y.cast("double") - p.cast("double")
        ),
        lambda x: x.isNotNull(),
    )
    keys = [F.col(k) if isinstance(k, str) else k for k in by or []]
    errors = predicted.select(*keys, off.alias("_off")).select(
        *[c for c in predicted.select(*keys).columns],
        F.size("_off").alias("_n"),
        F.aggregate("_off", F.lit(0.0), lambda a, x: a + x * x).alias("_square"),
        F.aggregate("_off", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("_absolute"),
    )
    total = F.sum("_n")
    covered = F.when(total > 0, total)
    return errors.groupBy(*predicted.select(*keys).columns).agg(
        total.alias("values"),
        (F.sum("_square") / covered).alias("mse"),
        (F.sum("_absolute") / covered).alias("mae"),
    )


def prediction_report(grid: DataFrame, predictions: DataFrame, spec: WindowSpec) -> DataFrame:
    """History columns, controlled columns not among them, and predicted columns, per position."""
    shown = list(dict.fromkeys([*spec.history, *spec.controlled]))
    base = grid.select("experiment_id", "idx", *[names.col(f) for f in shown])
    return prediction_timeline(base, predictions, spec.prediction)


def entries(batch: pa.RecordBatch, with_label: bool) -> np.ndarray:
    """A batch of windows as a matrix: flattened history, flattened controlled part, 1, and the flattened label if asked for."""
    count = batch.num_rows
    columns = [_flat(batch.column("history"), count), _flat(batch.column("controlled"), count), np.ones((count, 1))]
    if with_label:
        columns.append(_flat(batch.column("label"), count))
    return np.hstack(columns)


def _flat(column: pa.Array, count: int) -> np.ndarray:
    values = column.flatten().flatten()
    return np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(count, -1)
