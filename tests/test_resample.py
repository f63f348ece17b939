import random
from datetime import timedelta

import pytest

from sensorloom.operators import gates, resample
from sensorloom.settings import Grid
from tests.helpers import START, close, column, readings

F1, F2 = "sensor:intensity", "sensor:temperature"


def expected_bins(points, chunk_ns):
    """Means per chunk counted from midnight, as (first, {bin: mean})."""
    midnight = START.replace(hour=0, minute=0, second=0)
    bins = {}
    for second, value in points:
        since = START + timedelta(seconds=second) - midnight
        ns = (since.days * 86_400 + since.seconds) * 10**9 + since.microseconds * 1000
        bins.setdefault(ns // chunk_ns, []).append(value)
    return bins


@pytest.mark.parametrize("dps", [1, 6, 7, 11])
def test_means_follow_the_midnight_raster(spark, dps):
    draw = random.Random(dps)
    points = sorted({(draw.randrange(0, 900_000) / 1000, draw.uniform(1, 9)) for _ in range(80)})
    df = readings(spark, [(1, F1, s, v) for s, v in points])
    spec = Grid(dps_per_minute=dps)
    bins = expected_bins(points, spec.chunk_ns)
    first, last = min(bins), max(bins)
    want = [sum(bins[b]) / len(bins[b]) if b in bins else None for b in range(first, last + 1)]
    got = resample.resample_mean(df, (F1,), spec)
    close(column(got, F1), want)
    assert column(got, "idx") == list(range(last - first + 1))


def test_grid_spans_all_features_and_days(spark):
    df = readings(spark, [(1, F1, 0, 1.0), (1, F2, 100_000, 2.0)])
    got = resample.resample_mean(df, (F1, F2), Grid())
    assert got.count() == 100_000 // 10 + 1
    assert column(got, F1)[0] == 1.0 and column(got, F2)[-1] == 2.0
    assert sum(v is not None for v in column(got, F1)) == 1


def test_blocked_grid_equals_whole_grid(spark, monkeypatch):
    rows = [(e, F1, s, float(s)) for e in (1, 2) for s in (0, 5, 700, 701, 1500, 4000)]
    df = readings(spark, rows)
    whole = column(resample.resample_mean(df, (F1,), Grid()), F1)
    monkeypatch.setattr(resample, "BLOCK_ROWS", 16)
    monkeypatch.setattr(resample, "fits_one_block", lambda rows: False)
    blocked = resample.resample_mean(df, (F1,), Grid())
    assert column(blocked, F1) == whole
    assert column(blocked, "idx", 1) == list(range(len(whole) // 2))


def test_limits_themselves_are_outliers(spark):
    df = readings(spark, [(1, F1, s, v) for s, v in enumerate([0.0, 0.1, 199.9, 200.0, -5.0])])
    got = resample.null_outliers(df, {F1: (0, 200)}).orderBy("ts").collect()
    assert [r.value for r in got] == [None, 0.1, 199.9, None, None]


def test_length_gates(spark):
    ends = {1: 59, 2: 60, 3: 172_800, 4: 172_859, 5: 172_860}
    df = readings(spark, [(e, F1, s, 1.0) for e, end in ends.items() for s in (0, end)])
    extent = resample.experiment_extent(df, Grid())
    kept = {r.experiment_id for r in resample.within_limits(extent, Grid()).collect()}
    assert kept == {2, 3, 4}
    reasons = {r.experiment_id: r.reason for r in gates.out_of_limits(extent, Grid()).collect()}
    assert reasons == {1: "too short", 5: "too long"}


def test_extent_from_bins_equals_extent_from_readings(spark):
    draw = random.Random(3)
    df = readings(spark, [(e, f, draw.uniform(0, 5000), 1.0) for e in range(5) for f in (F1, F2) for _ in range(9)])
    direct = resample.experiment_extent(df, Grid(), (F1, F2)).orderBy("experiment_id").collect()
    binned = resample.bin_readings(df, (F1, F2), Grid())
    assert resample.extent_of_bins(binned, (F1, F2), Grid()).select(*direct[0].asDict()).orderBy("experiment_id").collect() == direct


def test_outlier_share_counts_aligned_rows(spark):
    rows = [(1, F1, s, v) for s, v in enumerate([0.0, 1.0, 2.0, None])] + [(1, F2, 10, 5.0)]
    got = {r.feature: r for r in resample.outlier_share(readings(spark, rows), {F1: (0, 9), F2: (0, 9)}).collect()}
    assert got[F1].aligned_rows == 5
    assert (got[F1].missing_before, got[F1].missing_after) == (2, 3)
    assert got[F1].outlier_percent == 20.0 and got[F1].alert
    assert got[F2].outlier_percent == 0.0 and not got[F2].alert


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_raw_readings_are_scanned_once(spark, tmp_path):
    rows = [(e, F1, s, float(s)) for e in range(1, 30) for s in range(0, 3000, 40)]
    readings(spark, rows).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    plan = final_plan(resample.resample_mean(raw, (F1,), Grid(6)))
    assert plan.count("Scan parquet") == 1
    # chunk sums, then one exchange by experiment
    assert len([line for line in plan.splitlines() if "Exchange hashpartitioning" in line]) == 2


def test_too_long_experiments_end_at_the_gate(spark):
    spec = Grid(6, max_duration_s=600)
    long = [(1, F1, s, 1.0) for s in range(0, 5000, 10)]
    sparse = [(2, F1, s, 1.0) for s in (0, 661)]
    fits = [(3, F1, s, 2.0) for s in (0, 300, 659)]
    short = [(4, F1, 0, 1.0)]
    got = resample.resample_mean(readings(spark, long + sparse + fits + short), (F1,), spec)
    extent = resample.within_limits(resample.experiment_extent(readings(spark, long + sparse + fits + short), spec), spec)
    assert {r.experiment_id for r in got.select("experiment_id").distinct().collect()} == {r.experiment_id for r in extent.collect()} == {3}
    assert column(got, F1)[0] == 2.0
