import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import epochs, forecast, windows
from sensorloom.plans import training
from sensorloom.settings import WindowSpec
from sensorloom.sources import tracking
from tests.helpers import grid, noisy

SPEC = WindowSpec(("a", "b"), ("a", "b"), ("c",), steps_history=2, steps_prediction=2)


@pytest.fixture(scope="module")
def data(spark):
    return grid(spark, {e: {c: noisy(f"{e}{c}", 22) for c in "abc"} for e in range(1, 9)}).cache()


def plain(cut):
    rows = windows.complete(cut).collect()
    x = np.array([[*np.ravel(r.history), *np.ravel(r.controlled), 1.0] for r in rows], float)
    y = np.array([np.ravel(r.label) for r in rows], float)
    return [(r.experiment_id, r.j) for r in rows], x, y


@pytest.mark.parametrize("loss", ["mse", "mae", "huber"])
def test_sums_equal_differences_of_the_loss(spark, data, loss):
    cut = windows.complete(windows.sliding_windows(data, SPEC))
    shape = forecast.Shape.of(SPEC)
    draw = np.random.default_rng(1)
    weights = draw.normal(size=(shape.inputs, shape.outputs))
    sums = epochs.batch_sums(cut, SPEC, weights, loss)
    _, x, y = plain(cut)
    error = x @ weights - y
    assert sums.windows == len(x)
    assert math.isclose(sums.square, (error**2).sum(), rel_tol=1e-9) and math.isclose(sums.absolute, np.abs(error).sum(), rel_tol=1e-9)
    for at in ((0, 0), (3, 2), (shape.inputs - 1, 1)):
        moved = weights.copy()
        moved[at] += 1e-6
        slope = (epochs.batch_sums(cut, SPEC, moved, loss).loss - sums.loss) / 1e-6
        assert math.isclose(sums.gradient[at], slope, rel_tol=1e-3, abs_tol=1e-3)


def test_steps_share_out_every_window_once(spark, data):
    cut = windows.sliding_windows(data, SPEC)
    stored = epochs.shard_windows(cut, seed=5)
    assert stored.count() == cut.count()
    for epoch in range(3):
        parts = epochs.dealt(epoch, 5, seed=5)
        assert sorted(s for p in parts for s in p) == list(range(epochs.SHARDS)) and all(parts)
    assert epochs.dealt(0, 5, 5) != epochs.dealt(1, 5, 5)
    # a step reads the folders of its shards only
    step = stored.where(F.col(epochs.SHARD).isin(epochs.dealt(0, 4)[0]))
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        epochs.dealt(0, 17)


def test_loss_falls_to_the_ridge_solution(spark, data):
    split = training.training_windows(data, SPEC)
    ids, x, y = plain(split.where("split = 'train'"))
    want = forecast.fit(split.where("split = 'train'"), SPEC, ridge=0.05).weights
    trained = training.train_epochs(data, SPEC, 60, 1, optimizer=epochs.Descent(1.0, 0.8), ridge=0.05)
    log = trained.log.orderBy("epoch").collect()
    assert [r.epoch for r in log] == list(range(1, 61))
    assert np.abs(trained.model.weights - want).max() < 0.05
    least = np.mean((x @ want - y) ** 2)
    assert log[-1].loss < log[0].loss and abs(log[-1].loss - least) < 0.02 * least
    assert log[-1].mse == log[-1].loss
    # the first row is the loss of the start, before any step
    assert math.isclose(log[0].loss, np.mean(y**2), rel_tol=1e-9)


def test_batches_follow_a_plain_version(spark, data):
    split = training.training_windows(data, SPEC)
    stored = epochs.shard_windows(split, shards=4)
    shard = {(r.experiment_id, r.j): r.shard for r in stored.collect()}
    ids, x, y = plain(split.where("split = 'train'"))
    numbers = np.array([shard[i] for i in ids])
    shape = forecast.Shape.of(SPEC)
    weights, other = np.zeros((shape.inputs, shape.outputs)), epochs.Adaptive(0.02)
    losses = []
    for epoch in range(2):
        seen = []
        for chosen in epochs.dealt(epoch, 2, shards=4):
            rows = np.isin(numbers, chosen)
            error = x[rows] @ weights - y[rows]
            seen.append(np.mean(error**2))
            weights = other.move(weights, 2 * x[rows].T @ error / error.size)
        losses.append(np.mean(seen))
    trained = training.train_epochs(data, SPEC, 2, 2, optimizer=epochs.Adaptive(0.02), shards=4)
    assert np.allclose(trained.model.weights, weights, atol=1e-9)
    assert np.allclose([r.loss for r in trained.log.orderBy("epoch").collect()], losses)


def test_early_stop_keeps_the_best_epoch(spark, data):
    trained = training.train_epochs(data, SPEC, 50, 1, optimizer=epochs.Descent(40.0), stop=epochs.EarlyStop(3))
    log = trained.log.orderBy("epoch").collect()
    assert len(log) < 50 and min(r.val_loss for r in log) == log[len(log) - 4].val_loss
    stop = epochs.EarlyStop(2, least_gain=0.1)
    assert [stop.over(v) for v in (1.0, 0.95, 0.85, 0.8, 0.79)] == [False, False, False, False, True]


def test_without_validation_or_windows(spark, data):
    trained = training.train_epochs(data, SPEC, 2, validation_share=0.0)
    assert [r.val_loss for r in trained.log.collect()] == [None, None]
    metrics = {r.key: r.value for r in tracking.epoch_metrics(trained.log, "r").collect()}
    assert set(metrics) == {"loss", "mse", "mae"}
    with pytest.raises(ValueError):
        training.train_epochs(grid(spark, {1: {c: noisy(c, 3) for c in "abc"}}), SPEC, 1)
    with pytest.raises(ValueError):
        training.train_epochs(data, SPEC, 1, steps_per_epoch=0)
