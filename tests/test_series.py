import pytest

from sensorloom.operators import series
from tests.helpers import close, column, grid, mean, noisy

MODES = [{"max_rows": 1000}, {"block_rows": 7}, {}]


@pytest.mark.parametrize("mode", MODES)
def test_fill_order(spark, mode):
    df = grid(spark, {1: {"a": [None, None, 1, None, None, None, 2, None], "b": [None] * 8}})
    got = series.fill_gaps(df, ("a", "b"), **mode)
    assert column(got, "a") == [1, 1, 1, 1, 1, 1, 2, 2]
    assert column(got, "b") == [None] * 8


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("width", [1, 4, 5, 20])
def test_centred_mean(spark, mode, width):
    values = {e: noisy(e, 30 + e, 0.2) for e in (1, 2)}
    got = series.smooth_centered(
        grid(spark, {e: {"a": v} for e, v in values.items()}), ("a",), width, **mode
    )
    for e, v in values.items():
        want = [mean(v[max(0, i - width // 2) : i + (width - 1) // 2 + 1]) for i in range(len(v))]
        close(column(got, "a", e), want)


def test_centred_mean_of_a_ramp(spark):
    df = grid(spark, {1: {"a": list(range(7))}})
    assert column(series.smooth_centered(df, ("a",), 4), "a") == [0.5, 1.0, 1.5, 2.5, 3.5, 4.5, 5.0]
    assert column(series.smooth_centered(df, ("a",), 5), "a") == [1.0, 1.5, 2.0, 3.0, 4.0, 4.5, 5.0]


def test_trim_happens_after_smoothing(spark):
    df = grid(spark, {1: {"a": [0, 0, 0, 9]}}).selectExpr("experiment_id", "idx", "ts", "3L as n_points", "a")
    assert column(series.smooth_centered(df, ("a",), 3), "a") == [0, 0, 3]
    assert series.smooth_centered(df, ("a",), 3, trim=False).count() == 4


@pytest.mark.parametrize("mode", MODES)
def test_trailing_mean(spark, mode):
    v = noisy(5, 40, 0.1)
    got = series.smooth_trailing(grid(spark, {1: {"a": v}}), ("a",), 6, **mode)
    close(column(got, "a"), [mean(v[max(0, i - 5) : i + 1]) for i in range(40)])


@pytest.mark.parametrize("mode", MODES)
def test_first_difference(spark, mode):
    v = [1, 3, None, 4, 4, 9, 0, 1, 1, 2]
    got = series.first_difference(grid(spark, {1: {"a": v}}), "a", "d", **mode)
    assert column(got, "d") == [0, 2, None, None, 0, 5, -9, 1, 0, 1]
