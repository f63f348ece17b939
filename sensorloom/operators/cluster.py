"""Soft-DTW k-means over curves, silhouettes, and choosing representatives."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import softdtw
from sensorloom.functions.hashing import uniform
from sensorloom.operators import curves as curve_ops
from sensorloom.session import keep

ROWS_AT_ONCE = 512
TILE_ROWS = 4096
# curves that travel together in a silhouette: some 17 MB at 64 points
BLOCK_CURVES = 32_768
# curves are few bytes but much work, so their tasks go by the cores and not by the bytes
TASKS_OF_CORE = 2
# a step that was halved so often moves nothing any more
LEAST_STEP = 1 / 64


@dataclass(frozen=True)
class Clustering:
    members: DataFrame  # experiment_id, cluster, distance
    centres: np.ndarray
    inertia: float
    rounds: int
    costs: tuple[float, ...]  # of the start and of each step taken; they never rise


def soft_dtw_kmeans(
    curves: DataFrame,
    clusters: int,
    max_rounds: int = 50,
    seed: int = 0,
    gamma: float = 1.0,
    tolerance: float = 1e-6,
) -> Clustering:
    """k-means under soft-DTW over (experiment_id, curve); all curves have one length.

    Centres move down the gradient of the summed distances to the nearest centres, each point by its own weight in the alignments. A step after which the cost
    is higher is halved until it is not. Every round is one pass: tasks assign their curves and add up, per cluster and curve point, the weights
    with which members align to it. Only centres and these sums, clusters x points numbers, reach the driver. Curves with
    missing values take no part.
    """
    known = curves.where(~F.exists("curve", lambda x: x.isNull())).select("experiment_id", "curve")
    tasks = TASKS_OF_CORE * curves.sparkSession.sparkContext.defaultParallelism
    stored = keep(known.repartition(tasks), "curves")
    centres = tried = _spread_start(stored, clusters, seed, gamma)
    direction, step, costs = np.zeros_like(centres), 1.0, []
    rounds = 0
    for rounds in range(1, max_rounds + 1):
        aim, cost = _round(stored, tried, gamma)
        if not costs or cost <= costs[-1]:
            still = bool(costs) and costs[-1] - cost < tolerance * max(1.0, abs(cost))
            centres, direction, step = tried, aim - tried, 1.0
            costs.append(cost)
            if still:
                break
        else:
            step /= 2
            if step < LEAST_STEP:
                break
        tried = centres + step * direction
    return Clustering(assign(stored, centres, gamma), centres, costs[-1], rounds, tuple(costs))


def assign(curves: DataFrame, centres: np.ndarray, gamma: float = 1.0) -> DataFrame:
    """The nearest centre of each curve (experiment_id, cluster, distance)."""

    def nearest(batches):
        for ids, values in _batches(batches):
            near = _distances(values, centres, gamma)
            yield pd.DataFrame(
                {"experiment_id": ids, "cluster": near.argmin(axis=1).astype(np.int64), "distance": near.min(axis=1)}
            )

    return curves.mapInPandas(nearest, "experiment_id bigint, cluster bigint, distance double")


def silhouette(curves: DataFrame, queries: Column | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Silhouette of each curve (experiment_id, cluster, silhouette, measure) by Euclidean distances to all curves of (.., curve, cluster).

    Curves fall into blocks by their ids. A task meets the curves of two blocks, compares tile_rows of them at once and returns each curve's summed distance to
    each cluster, so no pair leaves it: what is exchanged are the curves once per block, and clusters numbers for each curve and block. Blocks are
    few: as many as give every core some tasks, and more only where one would hold over BLOCK_CURVES. The work stays the number of
    pairs; queries (a condition) names the curves that are scored where that is too much, against all curves all the same.
    """
    plain = curves.select("experiment_id", F.col("cluster").cast("bigint").alias("cluster"), "curve")
    sizes = plain.groupBy("cluster").agg(F.count("*").alias("_size"))
    scored = plain if queries is None else plain.where(queries)
    cores = curves.sparkSession.sparkContext.defaultParallelism
    blocks, scored_blocks = (block_count(part.count(), tile_rows, cores) for part in (plain, scored))

    def block(count):
        return F.pmod(F.xxhash64("experiment_id"), F.lit(count)).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    ours = scored.select("*", block(scored_blocks).alias("_i"), every(blocks).alias("_j")).groupBy("_i", "_j")
    named = plain.select(F.col("cluster").alias("_c"), F.col("curve").alias("_x"), block(blocks).alias("_tj"), every(scored_blocks).alias("_ti"))
    theirs = named.groupBy("_ti", "_tj")

    def sums(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if own.empty or other.empty:
            return pd.DataFrame({c: [] for c in ("experiment_id", "cluster", "other", "total")})
        labels, place = np.unique(other["_c"].to_numpy(), return_inverse=True)
        x, y = np.stack(own["curve"].to_numpy()), np.stack(other["_x"].to_numpy())
        middle = y.mean(axis=0)
        x, y = x - middle, y - middle
        squares, member = (y * y).sum(axis=1), np.eye(len(labels))[place]
        tiles = [slice(start, start + tile_rows) for start in range(0, len(y), tile_rows)]
        total = np.vstack(
            [sum(_apart(a, y[t], squares[t]) @ member[t] for t in tiles) for a in np.array_split(x, math.ceil(len(x) / ROWS_AT_ONCE))]
        )
        names = {c: np.repeat(own[c].to_numpy(), len(labels)) for c in ("experiment_id", "cluster")}
        return pd.DataFrame({**names, "other": np.tile(labels, len(x)), "total": total.ravel()})

    parts = ours.cogroup(theirs).applyInPandas(sums, "experiment_id bigint, cluster bigint, other bigint, total double")
    spread = parts.groupBy("experiment_id", "cluster", "other").agg(F.sum("total").alias("_total"))
    spread = spread.join(sizes.withColumnRenamed("cluster", "other"), "other")
    mine = F.col("cluster") == F.col("other")
    ends = spread.groupBy("experiment_id", "cluster").agg(
        F.max(F.when(mine & (F.col("_size") > 1), F.col("_total") / (F.col("_size") - 1))).alias("_own"),
        F.min(F.when(~mine, F.col("_total") / F.col("_size"))).alias("_other"),
    )
    larger = F.greatest("_own", "_other")
    # a cluster of one, or no other cluster, has 0
    value = F.when(F.col("_own").isNotNull() & F.col("_other").isNotNull() & (larger > 0), (F.col("_other") - F.col("_own")) / larger).otherwise(0.0)
    return ends.select("experiment_id", "cluster", value.alias("silhouette"), F.lit("euclidean").alias("measure"))


def block_count(rows: int, tile_rows: int, cores: int) -> int:
    """Blocks of rows, so that pairs of blocks keep the cores busy; small sets have one for each tile."""
    busy = math.ceil(math.sqrt(2 * TASKS_OF_CORE * cores))
    return max(1, math.ceil(rows / BLOCK_CURVES), min(math.ceil(rows / tile_rows), busy))


def _apart(x: np.ndarray, y: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows; what cancels down to rounding is 0."""
    scale = (x * x).sum(axis=1)[:, None] + squares[None, :]
    square = scale - 2.0 * x @ y.T
    return np.sqrt(np.where(square > 1e-13 * scale, square, 0.0))


def mean_silhouette(scores: DataFrame) -> DataFrame:
    return scores.groupBy("measure").agg(F.avg("silhouette").alias("silhouette"))


def silhouette_squared(curves: DataFrame) -> DataFrame:
    """As silhouette, but by squared distances: with each cluster's size, sum and sum of squares a curve's mean distance to it needs no other curve, so
    the work is linear in the number of curves.
    """
    score = _against_sums(curves)

    def scores(batches):
        for batch in batches:
            if len(batch):
                found = score(np.stack(batch["curve"].to_numpy()), batch["cluster"].to_numpy())
                yield pd.DataFrame(
                    {"experiment_id": batch["experiment_id"], "cluster": batch["cluster"], "silhouette": found}
                )

    plain = curves.select("experiment_id", F.col("cluster").cast("bigint").alias("cluster"), "curve")
    return plain.mapInPandas(scores, "experiment_id bigint, cluster bigint, silhouette double").withColumn(
        "measure", F.lit("squared_euclidean")
    )


@dataclass(frozen=True)
class Selection:
    members: DataFrame  # experiment_id, cluster, score, rank of the chosen ones
    scores: DataFrame
    silhouette: DataFrame
    clustering: Clustering


def cluster_select(
    grid: DataFrame,
    clusters: int,
    per_cluster: int,
    max_rounds: int = 50,
    seed: int = 0,
    scored: Column | None = None,
    max_rows: int | None = None,
) -> Selection:
    """Cluster experiments by their temperature curve and take those nearest to each cluster's middle; scored limits the silhouettes."""
    feature = curve_ops.cluster_feature(grid.columns)
    curves = keep(curve_ops.resample_curve(grid, feature), "curves")
    clustering = soft_dtw_kmeans(curves, clusters, max_rounds, seed)
    members = keep(clustering.members, "members")
    scores = curve_ops.cluster_scores(curve_ops.describe(grid, feature, max_rows), members)
    labelled = curves.join(members.select("experiment_id", "cluster"), "experiment_id")
    return Selection(
        curve_ops.cluster_top_n(scores, per_cluster), scores, silhouette(labelled, scored), clustering
    )


def _batches(batches):
    for batch in batches:
        for start in range(0, len(batch), ROWS_AT_ONCE):
            part = batch.iloc[start : start + ROWS_AT_ONCE]
            yield part["experiment_id"].to_numpy(), np.stack(part["curve"].to_numpy())


def _distances(values: np.ndarray, centres: np.ndarray, gamma: float) -> np.ndarray:
    return np.stack([softdtw.distances(values, c, gamma) for c in centres], axis=1)


def _spread_start(curves: DataFrame, clusters: int, seed: int, gamma: float) -> np.ndarray:
    """First centres one by one, curves far from the earlier ones being likelier (k-means++).

    The draw is a race: the curve with the smallest -ln(u) / distance wins, u coming from its id. Each curve keeps the
    distance to its nearest centre so far beside it, so a turn compares it with the newest centre only and exchanges nothing.
    """

    def start(batches):
        for ids, values in _batches(batches):
            # soft-DTW of a curve with itself lies below zero
            own = softdtw.self_distances(values, gamma)
            yield pd.DataFrame({"experiment_id": ids, "curve": list(values), "_own": own, "_near": np.inf, "_d": 1.0})

    columns = "experiment_id bigint, curve array<double>, _own double, _near double, _d double"
    state = keep(curves.mapInPandas(start, columns), "start")
    centres = []
    for turn in range(clusters):
        race = F.when(F.col("_d") > 0.0, -F.log(uniform(F.col("experiment_id"), seed, turn)) / F.col("_d"))
        first = state.agg(F.min_by("curve", F.struct(race.isNull(), race, F.col("experiment_id")))).first()[0]
        if first is None:
            raise ValueError("no curve to cluster")
        newest = np.array(first)
        centres.append(newest)
        if turn == clusters - 1:
            break

        def nearer(batches, newest=newest):
            for batch in batches:
                for begin in range(0, len(batch), ROWS_AT_ONCE):
                    part = batch.iloc[begin : begin + ROWS_AT_ONCE]
                    apart = softdtw.distances(np.stack(part["curve"].to_numpy()), newest, gamma)
                    near = np.minimum(part["_near"].to_numpy(), apart)
                    yield part.assign(_near=near, _d=np.maximum(near - part["_own"].to_numpy(), 0.0))

        state = keep(state.mapInPandas(nearer, columns), "start")
    return np.array(centres)


def _round(curves: DataFrame, centres: np.ndarray, gamma: float):
    """Where a whole step takes the centres, and the cost where they are."""

    def sums(batches):
        shape = centres.shape
        pulled, weights = np.zeros(shape), np.zeros(shape)
        cost = np.zeros(shape[0])
        for _, values in _batches(batches):
            near = _distances(values, centres, gamma)
            label = near.argmin(axis=1)
            for c in np.unique(label):
                own = values[label == c]
                share = softdtw.alignment(own, centres[c], gamma)
                pulled[c] += np.einsum("nst,ns->t", share, own)
                weights[c] += share.sum(axis=(0, 1))
                cost[c] += near[label == c, c].sum()
        cluster, point = np.indices(shape)
        yield pd.DataFrame(
            {
                "cluster": cluster.ravel(),
                "point": point.ravel(),
                "pulled": pulled.ravel(),
                "weight": weights.ravel(),
                "cost": np.where(point == 0, cost[:, None], 0.0).ravel(),
            }
        )

    found = (
        curves.mapInPandas(sums, "cluster int, point int, pulled double, weight double, cost double")
        .groupBy("cluster", "point")
        .agg(F.sum("pulled").alias("pulled"), F.sum("weight").alias("weight"), F.sum("cost").alias("cost"))
        .collect()
    )
    moved = centres.copy()
    for row in found:
        if row.weight > 0.0:
            moved[row.cluster, row.point] = row.pulled / row.weight
    return moved, sum(row.cost for row in found)


def _cluster_sums(curves: DataFrame):
    """Per cluster its size, sum of squares and sums by point: clusters x points numbers, added up in Spark."""
    squares = F.aggregate("curve", F.lit(0.0), lambda a, x: a + x * x)
    sizes = curves.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(squares).alias("q")).collect()
    width = curves.agg(F.max(F.size("curve"))).first()[0]
    points = (
        curves.select("cluster", F.posexplode("curve").alias("point", "x"))
        .groupBy("cluster", "point").agg(F.sum("x").alias("s")).collect()
    )
    order = {int(row.cluster): i for i, row in enumerate(sizes)}
    total = np.zeros((len(order), width))
    for row in points:
        total[order[int(row.cluster)], row.point] = row.s
    return order, np.array([row.n for row in sizes], dtype=float), np.array([row.q for row in sizes]), total


def _against_sums(curves: DataFrame):
    order, size, squares, total = _cluster_sums(curves)

    def score(values, label):
        place = np.array([order[int(c)] for c in label])
        own_square = (values**2).sum(axis=1)
        spread = own_square[:, None] * size[None, :] - 2.0 * values @ total.T + squares[None, :]
        return _silhouettes(np.maximum(spread, 0.0), place, size)

    return score


def _silhouettes(spread: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """From each curve's summed distance to each cluster; 0 for a cluster of one."""
    rows = np.arange(len(place))
    others = size[place] - 1.0
    own = spread[rows, place] / np.maximum(others, 1.0)
    mean = spread / size[None, :]
    mean[rows, place] = np.inf
    other = mean.min(axis=1)
    larger = np.maximum(own, other)
    return np.where((others > 0) & (larger > 0) & np.isfinite(other), (other - own) / np.where(larger > 0, larger, 1.0), 0.0)
