import math

import numpy as np
from pyspark.sql import functions as F

from sensorloom.functions import names
from sensorloom.operators import particles
from tests.helpers import close, column, grid

BINS = ("fbrm:counts_10", "fbrm:counts_10-50", "fbrm:counts_50-150", "fbrm:counts_150-300")


def test_bin_limits(spark):
    rows = ["fbrm:counts_10", "fbrm:counts_10-50", "fbrm:counts_1000", "fbrm:counts_300-1000", "sensor:x"]
    df = spark.createDataFrame([(r,) for r in rows], "name string")
    lo, hi = names.bin_limits(F.col("name"))
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(0, 10), (10, 50), (1000, 1001), (300, 1000), (0, 0)]


def test_percentages_of_an_empty_row(spark):
    df = grid(spark, {1: {b: v for b, v in zip(BINS, ([0, 1], [0, 1], [0, 2], [0, 0]))}})
    got = particles.bin_percentages(df, BINS)
    assert [column(got, b) for b in BINS] == [[0, 0.25], [0, 0.25], [0, 0.5], [0, 0]]


def test_distribution_keeps_mass_and_shape(spark):
    counts = [5.0, 60.0, 30.0, 5.0]
    df = grid(spark, {1: {b: [v] for b, v in zip(BINS, counts)}})
    csd = particles.csd_from_bins(df, BINS, F.lit(70.0), F.lit(2.34), step=1.0, l_max=300.0)
    assert csd.count() == 300
    moments = particles.csd_moments(csd, F.lit(2.34)).first()
    assert math.isclose(moments.mass, 70.0, rel_tol=1e-9)
    rows = sorted((r.l, r.f) for r in csd.collect())
    share = np.array([f for _, f in rows])
    share /= share.sum()
    weights = np.array(counts) / 100 * np.array([5, 30, 100, 225])
    sizes = np.linspace(0, 300, 300)
    pdf = np.exp(-0.5 * ((sizes - weights.sum()) / weights.std()) ** 2)
    assert np.allclose(share, pdf / pdf.sum())
    bins = particles.csd_to_bins(csd, BINS).first()
    want = [share[(sizes >= lo) & (sizes < hi)].sum() for lo, hi in ((0, 10), (10, 50), (50, 150), (150, 300))]
    assert np.allclose([bins[b] for b in BINS], want)


def test_arrays_and_rows_agree_and_arrays_exchange_nothing(spark):
    counts = [[5.0, 0.0, 0.0, 1e-9, 40.0], [60.0, 0.0, 7.0, 0.0, 0.0], [30.0, 0.0, 7.0, 0.0, None], [5.0, 0.0, 1.0, 0.0, 2.0]]
    df = grid(spark, {e: {b: v for b, v in zip(BINS, counts)} for e in (1, 2)})
    options = {"step": 1.0, "l_max": 300.0}
    arrays = particles.csd_arrays(df, BINS, F.lit(70.0), F.lit(2.34), **options)
    rows = particles.csd_from_bins(df, BINS, F.lit(70.0), F.lit(2.34), **options)
    key = lambda r: (r["experiment_id"], r["t"])
    pairs = (
        (particles.arrays_to_bins(arrays, BINS, **options), particles.csd_to_bins(rows, BINS)),
        (particles.array_moments(arrays, F.lit(2.34), **options), particles.csd_moments(rows, F.lit(2.34))),
    )
    for one, two in pairs:
        assert one.columns == two.columns
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString().split("Scan")[0]
        for a, b in zip(sorted(one.collect(), key=key), sorted(two.collect(), key=key), strict=True):
            close([*a], [*b], 1e-9)
    amounts = particles.arrays_to_bins(arrays, BINS, percentage=False, **options)
    lost = {(r.experiment_id, r.t) for r in amounts.where(F.col(f"`{BINS[0]}`").isNull()).collect()}
    assert lost == {(r.experiment_id, r.t) for r in rows.where("f is null").select("experiment_id", "t").distinct().collect()}
    assert {(1, 1.0), (1, 4.0)} <= lost and rows.count() == 2 * 5 * 300
    assert particles.csd_arrays(df.limit(0), BINS, F.lit(1.0), F.lit(1.0), **options).count() == 0
    assert [names.bin_limits_of(b) for b in (*BINS, "fbrm:counts_1000", "sensor:x")] == [(0, 10), (10, 50), (50, 150), (150, 300), (1000, 1001), (0, 0)]


def test_size_index_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.4,)], "l double")
    assert [r[0] for r in df.select(particles.size_index(F.col("l"), 1.0)).collect()] == [0, 2, 2]
