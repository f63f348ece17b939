import math

import numpy as np
import pytest

from sensorloom.functions import softdtw
from sensorloom.operators import augment, cluster, curves
from tests.helpers import close, column, grid, noisy


def plain_soft_dtw(x, y, gamma=1.0):
    r = np.full((len(x) + 1, len(y) + 1), np.inf)
    r[0, 0] = 0.0
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            z = np.array([r[i - 1, j - 1], r[i - 1, j], r[i, j - 1]])
            low = z.min()
            r[i, j] = (x[i - 1] - y[j - 1]) ** 2 + low - gamma * math.log(np.exp((low - z) / gamma).sum())
    return r[-1, -1]


def test_soft_dtw_against_the_definition():
    rng = np.random.default_rng(1)
    xs, y = rng.normal(size=(6, 9)), rng.normal(size=9)
    assert np.allclose(softdtw.distances(xs, y), [plain_soft_dtw(x, y) for x in xs])
    assert np.allclose(softdtw.self_distances(xs), [plain_soft_dtw(x, x) for x in xs])


def test_alignment_is_the_gradient():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(1, 6)), rng.normal(size=6)
    share = softdtw.alignment(x, y)[0]
    slope = np.array([(share[:, t] * 2 * (y[t] - x[0])).sum() for t in range(6)])
    step = 1e-6
    for t in range(6):
        up, down = y.copy(), y.copy()
        up[t] += step
        down[t] -= step
        numeric = (softdtw.distances(x, up)[0] - softdtw.distances(x, down)[0]) / (2 * step)
        assert math.isclose(slope[t], numeric, rel_tol=1e-4, abs_tol=1e-6)


def curve_table(spark, rows):
    return spark.createDataFrame(
        [(i, [float(v) for v in c], int(k)) for i, (c, k) in enumerate(rows)],
        "experiment_id bigint, curve array<double>, cluster int",
    )


def test_kmeans_parts_two_shapes_whatever_the_partitioning(spark):
    rng = np.random.default_rng(3)
    t = np.linspace(0, 1, 20)
    rows = [(t * 4 + rng.normal(0, 0.05, 20), 0) for _ in range(12)] + [(4 - t * 4 + rng.normal(0, 0.05, 20), 1) for _ in range(8)]
    table = curve_table(spark, rows)
    first = cluster.soft_dtw_kmeans(table, 2, max_rounds=6)
    label = {r.experiment_id: r.cluster for r in first.members.collect()}
    assert len({label[i] for i in range(12)}) == 1 and len({label[i] for i in range(12, 20)}) == 1
    assert label[0] != label[19]
    again = cluster.soft_dtw_kmeans(table.repartition(5), 2, max_rounds=6)
    assert np.allclose(first.centres, again.centres)


@pytest.mark.parametrize("seed", [0, 5])
def test_costs_never_rise_and_halved_steps_are_taken(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    rows = [(rng.normal(0, 2, 12), 0) for _ in range(30)]
    table = curve_table(spark, rows)
    found = cluster.soft_dtw_kmeans(table, 3, max_rounds=12, seed=seed)
    assert len(found.costs) > 2 and all(b <= a for a, b in zip(found.costs, found.costs[1:]))
    total = sum(r.distance for r in found.members.collect())
    assert math.isclose(total, found.costs[-1], rel_tol=1e-9) and found.inertia == found.costs[-1]
    # steps four times too long have to be halved
    whole = cluster._round

    def too_far(curves, centres, gamma):
        aim, cost = whole(curves, centres, gamma)
        return centres + 4 * (aim - centres), cost

    monkeypatch.setattr(cluster, "_round", too_far)
    pushed = cluster.soft_dtw_kmeans(table, 3, max_rounds=12, seed=seed)
    assert all(b <= a for a, b in zip(pushed.costs, pushed.costs[1:])) and pushed.rounds > len(pushed.costs)


def plain_silhouettes(rows, power):
    scores = []
    for i, (x, k) in enumerate(rows):
        apart = {}
        for j, (y, other) in enumerate(rows):
            if i != j:
                apart.setdefault(other, []).append(np.linalg.norm(x - y) ** power)
        own = np.mean(apart.pop(k)) if k in apart else None
        if own is None or not apart:
            scores.append(0.0)
            continue
        other = min(np.mean(v) for v in apart.values())
        scores.append((other - own) / max(own, other) if max(own, other) else 0.0)
    return scores


@pytest.mark.parametrize("labels", [(0, 0, 0, 1, 1, 1, 1, 2), (0, 0, 0, 0, 0, 0, 0, 0), (0, 1, 2, 3, 4, 5, 6, 7)])
def test_silhouettes_against_all_pairs(spark, labels):
    rng = np.random.default_rng(4)
    rows = [(rng.normal(k % 3, 1, 5), k) for k in labels]
    # two equal curves, one of them in a cluster of its own
    rows[7] = (rows[6][0], rows[7][1])
    table = curve_table(spark, rows)
    for found, power in ((cluster.silhouette(table), 1), (cluster.silhouette(table, tile_rows=3), 1), (cluster.silhouette_squared(table), 2)):
        got = {r.experiment_id: r.silhouette for r in found.collect()}
        close([got[i] for i in range(8)], plain_silhouettes(rows, power), 1e-6)
    some = cluster.silhouette(table, table["experiment_id"] % 3 == 0, tile_rows=3)
    got = {r.experiment_id: r.silhouette for r in some.collect()}
    close([got[i] for i in (0, 3, 6)], [plain_silhouettes(rows, 1)[i] for i in (0, 3, 6)], 1e-6)
    assert len(got) == 3
    mean = cluster.mean_silhouette(cluster.silhouette(table)).first()
    assert mean.measure == "euclidean" and math.isclose(mean.silhouette, np.mean(plain_silhouettes(rows, 1)), abs_tol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 7, 50, 51, 173])
def test_resampled_curve(spark, n):
    values = noisy(n, n)
    at = np.linspace(0, n - 1, 50)
    want = list(np.interp(at, np.arange(n), values))
    long = curves.resample_curve(grid(spark, {1: {"a": values}}), "a").first().curve
    close(long, want)
    array = curves.resample_array(spark.createDataFrame([(1, values)], "experiment_id bigint, curve array<double>"))
    close(array.first().curve, want)


def test_scores_single_member_and_ties(spark):
    table = spark.createDataFrame(
        [(5, 1.0, 0.5), (3, 3.0, 0.5), (9, 7.0, 1.0)], "experiment_id bigint, mean double, std double"
    )
    members = spark.createDataFrame([(5, 0), (3, 0), (9, 1)], "experiment_id bigint, cluster bigint")
    scores = curves.cluster_scores(table, members)
    assert {r.experiment_id: r.score for r in scores.collect()} == {5: 0.5, 3: 0.5, 9: 0.0}
    assert {r.experiment_id for r in curves.cluster_top_n(scores, 1).collect()} == {3, 9}
    empty = [r for r in curves.cluster_members(members, 3).collect() if r.cluster == 2]
    assert len(empty) == 1 and empty[0].experiment_id is None and empty[0].size == 0


def test_center_trim(spark):
    df = grid(spark, {1: {"a": list(range(5))}, 2: {"a": list(range(10))}, 3: {"a": list(range(8))}})
    got = curves.center_trim(df)
    assert column(got, "a", 1) == [0, 1, 2, 3, 4]
    assert column(got, "a", 2) == [2, 3, 4, 5, 6]
    assert column(got, "a", 3) == [1, 2, 3, 4, 5]
    assert column(got, "idx", 2) == [0, 1, 2, 3, 4]


def test_resize_plan():
    assert curves.resize_plan(3, 10, 20, 4) == ("augment", 7)
    assert curves.resize_plan(30, 10, 20, 4) == ("cluster", 5)
    assert curves.resize_plan(30, 10, 20, 40) == ("cluster", 1)
    assert curves.resize_plan(15, 10, 20, 4) == ("keep", 0)


def test_digest(spark, monkeypatch):
    import hashlib

    ids = spark.createDataFrame([(10,), (9,), (100,), (9,)], "experiment_id bigint")
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    assert curves.experiments_digest(ids).first().digest == md5(md5("9\n10\n100"))
    monkeypatch.setattr(curves, "RANGE_IDS", 50)
    assert curves.experiments_digest(ids).first().digest == md5(md5("9\n10") + "\n" + md5("100"))


def test_jitter_is_repeatable_and_has_the_asked_spread(spark):
    df = grid(spark, {e: {"a": [0.5] * 400, "b": [0.1] * 400} for e in range(1, 6)})
    one = augment.jitter(df, ("a", "b"), 4, width=1, level=0.05, seed=1)
    two = augment.jitter(df.repartition(3), ("a", "b"), 4, width=1, level=0.05, seed=1)
    a = column(one, "a")
    assert a == column(two, "a") and len(a) == 1600
    assert sorted({r.experiment_id for r in one.select("experiment_id").distinct().collect()}) == [2000, 2001, 2002, 2003]
    assert abs(np.mean(a) - 0.5) < 0.005 and abs(np.std(a) - 0.05) < 0.004
    assert abs(np.corrcoef(a, column(one, "b"))[0, 1]) < 0.1


def test_synthetic_ids_step_aside(spark):
    df = grid(spark, {2500: {"a": [0.5] * 5}})
    got = augment.jitter(df, ("a",), 2, width=2)
    assert {r.experiment_id for r in got.collect()} == {2501, 2502}


def test_soft_dtw_of_near_and_far_curves_in_one_batch():
    rng = np.random.default_rng(3)
    y = rng.random(6)
    xs = np.vstack([rng.random((2, 7)), 40.0 * rng.random((2, 7)), rng.random((1, 7))])
    assert np.allclose(softdtw.distances(xs, y, 0.5), [plain_soft_dtw(x, y, 0.5) for x in xs], rtol=1e-12)
    assert np.allclose(softdtw.self_distances(xs, 0.5), [plain_soft_dtw(x, x, 0.5) for x in xs], rtol=1e-12)
    assert np.allclose(softdtw.alignment(xs, y), np.vstack([softdtw.alignment(x[None], y) for x in xs]))
    # an alignment passes the first and the last cell
    assert np.allclose(softdtw.alignment(xs, y)[:, [0, -1], [0, -1]], 1.0)


def test_soft_dtw_takes_one_exp_for_a_cell(monkeypatch):
    taken = []

    def counted(values, **options):
        taken.append(np.size(values))
        return np.exp(values, **options)

    class Counting:
        exp = staticmethod(counted)

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(softdtw, "np", Counting())
    xs, y = np.random.default_rng(4).random((3, 50)), np.linspace(0.0, 1.0, 50)
    softdtw.distances(xs, y)
    softdtw.alignment(xs, y)
    assert sum(taken) == 2 * 3 * 50 * 50


def test_a_silhouette_exchanges_few_blocks_however_small_its_tiles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [float(v) for v in rng.normal(size=4)]) for i in range(60)]
    table = spark.createDataFrame(rows, "experiment_id bigint, cluster bigint, curve array<double>")
    tiled, whole = (cluster.silhouette(table, tile_rows=n) for n in (1, 100))
    one, other = ({r.experiment_id: r.silhouette for r in found.collect()} for found in (tiled, whole))
    assert len(one) == 60 and all(math.isclose(one[k], other[k], abs_tol=1e-12) for k in one)
    # copies of a curve do not grow with the set as long as blocks fit a task
    assert [cluster.block_count(n, 200, 12) for n in (100, 10_000, 100_000, 600_000)] == [1, 7, 7, 19]
