import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import forecast, windows
from sensorloom.plans import training
from sensorloom.settings import WindowSpec
from tests.helpers import column, grid, noisy

SPEC = WindowSpec(("a", "b"), ("a", "b"), ("c",), steps_history=3, steps_prediction=2)


@pytest.fixture(scope="module")
def data(spark):
    return grid(spark, {e: {c: noisy(f"{e}{c}", 25) for c in "abc"} for e in range(1, 9)}).cache()


def matrices(cut):
    rows = cut.collect()
    x = [[*np.ravel(r.history), *np.ravel(r.controlled), 1.0] for r in rows]
    return np.array(x, dtype=float), np.array([np.ravel(r.label) for r in rows], dtype=float)


def test_fit_equals_the_normal_equations(spark, data):
    cut = windows.sliding_windows(data, SPEC)
    model = forecast.fit(cut, SPEC, ridge=0.1)
    x, y = matrices(cut)
    penalty = np.diag([0.1] * (x.shape[1] - 1) + [0.0])
    want = np.linalg.solve(x.T @ x / len(x) + penalty, x.T @ y / len(x))
    assert np.allclose(model.weights, want)
    total = forecast.as_matrix(forecast.gramian(cut, SPEC), forecast.Shape.of(SPEC))
    assert math.isclose(forecast.squared_error(total, model), np.mean((x @ want - y) ** 2), rel_tol=1e-6)


def test_predictions_and_errors(spark, data):
    cut = windows.sliding_windows(data, SPEC)
    model = forecast.fit(cut, SPEC)
    predicted = forecast.predict(cut, model)
    x, y = matrices(cut)
    got = np.array([np.ravel(r.prediction) for r in predicted.orderBy("experiment_id", "j").collect()])
    order = np.argsort([(r.experiment_id * 1000 + r.j) for r in cut.collect()])
    assert np.allclose(got, (x @ model.weights)[order], atol=1e-5)
    errors = forecast.forecast_metrics(predicted).first()
    assert errors["values"] == y.size
    assert math.isclose(errors.mse, np.mean((x @ model.weights - y) ** 2), rel_tol=1e-4)
    assert math.isclose(errors.mae, np.mean(np.abs(x @ model.weights - y)), rel_tol=1e-4)


def test_windows_with_missing_values_are_not_fitted_on(spark):
    values = noisy(1, 40)
    values[20] = None
    df = grid(spark, {1: {"a": values, "b": noisy(2, 40), "c": noisy(3, 40)}})
    cut = windows.sliding_windows(df, SPEC)
    shape = forecast.Shape.of(SPEC)
    total = forecast.as_matrix(forecast.gramian(cut, SPEC), shape)
    assert total[shape.inputs - 1, shape.inputs - 1] == cut.count() - 5
    model = forecast.fit(cut, SPEC)
    lost = forecast.predict(cut, model).where(F.col("prediction")[0][0].isNull()).count()
    assert lost == 3


def test_timeline_of_one_and_two_features(spark, data):
    for outputs in (("a",), ("a", "b")):
        spec = WindowSpec(("a", "b"), outputs, ("c",), 3, 2)
        model = forecast.fit(windows.sliding_windows(data, spec), spec)
        report = forecast.prediction_report(data, forecast.predict(windows.predict_windows(data, spec), model), spec)
        assert report.columns == ["experiment_id", "idx", "a", "b", "c", *[f"{f}_PREDICTED" for f in outputs]]
        shown = [i for i, v in enumerate(column(report, "a_PREDICTED", 1)) if v is not None]
        assert shown == [3, 4, 7, 8, 11, 12, 15, 16, 19, 20]


def test_training_and_sweep_agree(spark, data):
    trained = training.train(data, SPEC, ridge=0.05)
    by_split = {r.split: r for r in trained.metrics.collect()}
    trials = training.grid_suggestions(nr_timesteps_history=[3, 4, 30], ridge=[0.05, 1.0])
    table = {r.trial: r for r in training.param_sweep(data, SPEC, trials).collect()}
    assert len(table) == 6
    assert math.isclose(table[0].loss, by_split["train"].mse, rel_tol=1e-4)
    assert math.isclose(table[0].val_loss, by_split["validation"].mse, rel_tol=1e-4)
    assert table[4].objective is None  # no window of 30 rows


def test_suggestions_follow_the_kind_of_list():
    config = {
        "dataset": {"nr_clusters": [2, 20], "substance": ["aa", "pdp"]},
        "model": {"batch_size": [8, 16, 32], "list_units_per_layer": [64], "nr_timesteps_history": 10},
        "optimizer": {"learning_rate": [0.1, 0.5]},
    }
    drawn = training.suggestions(config, 20)
    assert drawn == training.suggestions(config, 20)
    for values in drawn:
        assert set(values) == {"nr_clusters", "batch_size", "learning_rate"}
        assert 2 <= values["nr_clusters"] <= 20 and isinstance(values["nr_clusters"], int)
        assert values["batch_size"] in (8, 16, 32) and 0.1 <= values["learning_rate"] <= 0.5
