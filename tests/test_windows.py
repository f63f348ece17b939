import pytest

from sensorloom.operators import ordering, windows
from sensorloom.settings import WindowSpec
from tests.helpers import close, column, grid, noisy

SPEC = WindowSpec(("a", "b"), ("a",), ("c",), steps_history=4, steps_prediction=3)


def frame(spark, lengths, missing=0.0):
    return grid(
        spark, {e: {c: noisy(f"{e}{c}", n, missing) for c in "abc"} for e, n in lengths.items()}
    )


@pytest.mark.parametrize("mode", [{"max_rows": 1000}, {"block_rows": 5}])
def test_window_counts_and_contents(spark, mode):
    lengths = {1: 6, 2: 7, 3: 8, 4: 30}
    df = frame(spark, lengths)
    got = windows.sliding_windows(df, SPEC, **mode).collect()
    counts = {e: sum(r.experiment_id == e for r in got) for e in lengths}
    assert counts == {1: 0, 2: 0, 3: 1, 4: 23}
    a, b, c = (column(df, n, 4) for n in "abc")
    for r in got:
        if r.experiment_id == 4:
            close([x for row in r.history for x in row], [x for i in range(r.j - 4, r.j) for x in (a[i], b[i])], 1e-6)
            close([row[0] for row in r.label], a[r.j : r.j + 3], 1e-6)
            close([row[0] for row in r.controlled], c[r.j : r.j + 3], 1e-6)


def test_prediction_windows_are_strided_and_not_all_zero(spark):
    n = 30
    df = grid(spark, {1: {"a": [0.0] * 10 + [1.0] * 20, "b": [0.0] * n, "c": [1.0] * n}})
    got = sorted(r.j for r in windows.predict_windows(df, SPEC).collect())
    assert got == [16, 22]  # 4 and 10 see zeros only


def test_unwindow_gives_the_covered_rows_back(spark):
    df = frame(spark, {1: 20, 2: 9})
    back = windows.unwindow(windows.sliding_windows(df, SPEC), SPEC)
    for e, n in {1: 20, 2: 9}.items():
        last = n - 4
        assert column(back, "idx", e) == list(range(last + 3))
        close(column(back, "h:a", e), column(df, "a", e)[:last] + [None] * 3, 1e-6)
        close(column(back, "c:c", e), [None] * 4 + column(df, "c", e)[4 : last + 3], 1e-6)


def test_means_skip_missing_values(spark):
    df = grid(spark, {1: {"a": [1, None, 3, None] + [0] * 6, "b": [None] * 4 + [0] * 6, "c": [0] * 10}})
    first = windows.window_means(windows.sliding_windows(df, SPEC), SPEC).where("j = 4").first()
    assert first.a == 2.0 and first.b is None


def test_split_never_divides_and_ignores_partitioning(spark):
    ids = spark.range(101).withColumnRenamed("id", "experiment_id")
    one = {r.experiment_id: r.split for r in ordering.group_split(ids.repartition(1), 0.2).collect()}
    many = {r.experiment_id: r.split for r in ordering.group_split(ids.repartition(7).union(ids), 0.2).collect()}
    assert one == many and len(one) == 101
    assert sum(s == "train" for s in one.values()) == 81


def test_batches_are_full_and_reshuffled(spark):
    cut = windows.sliding_windows(frame(spark, {e: 20 for e in range(1, 6)}), SPEC)
    first, again, other = (
        sorted((r.batch_id, r.place, r.experiment_id, r.j) for r in b.collect())
        for b in (
            ordering.batches(cut, 8, epoch=0),
            ordering.batches(cut.repartition(3), 8, epoch=0),
            ordering.batches(cut, 8, epoch=1),
        )
    )
    assert first == again and first != other
    assert [(b, p) for b, p, _, _ in first] == [(b, p) for b in range(65 // 8) for p in range(8)]
    assert len({(e, j) for _, _, e, j in first}) == 64


def test_batches_of_a_grid_are_those_of_its_windows(spark):
    grid = frame(spark, {e: 20 for e in range(1, 6)})
    one = ordering.batches(windows.sliding_windows(grid, SPEC), 8, epoch=2)
    two = ordering.batched_windows(grid, SPEC, 8, epoch=2)
    assert sorted(map(repr, one.select(*two.columns).collect())) == sorted(map(repr, two.collect()))


def test_windows_are_never_broadcast(spark, tmp_path):
    frame(spark, {e: 20 for e in range(1, 6)}).write.parquet(f"{tmp_path}/grid")
    cut = windows.sliding_windows(spark.read.parquet(f"{tmp_path}/grid"), SPEC, max_rows=20)
    split = ordering.group_split(cut.select("experiment_id"), 0.2)
    for placed in (ordering.split_windows(cut, split), ordering.batches(cut, 8)):
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "BuildLeft" not in plan
