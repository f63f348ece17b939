"""Queries over curves, clusters and augmentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sensorloom.operators import augment, cluster, gates, quantiles
from sensorloom.operators import curves as ops
from sensorloom.session import keep
from sensorloom.settings import CURVE_POINTS, EXPERIMENT_BATCHES, JITTER_LEVEL
from workload.adapters import FEATURES, GRID, SMOOTHING, curves, long_form, prepared_sql, readings, table
from workload.process import prepared
from workload.registry import query

LAST = CURVE_POINTS - 1
CLUSTERS = 10
EMPTY_TOO = 12
TOP = 3
SEED = 7
SAMPLES = 20
TEMPERATURE = "sensor:temperature"
# points of a curve in the given table
CURVE_ROWS = 64


def curve_grid(spark, sf_dir):
    """Each curve as a small grid, its points in rows."""
    return curves(spark, sf_dir).select("experiment_id", F.posexplode("curve").alias("idx", "value"))


def members(spark, sf_dir):
    return curves(spark, sf_dir).select("experiment_id", F.col("cluster").cast("bigint").alias("cluster"))


def samples_long(df):
    return df.select("experiment_id", F.posexplode("curve").alias("k", "value")).select(
        "experiment_id", F.col("k").cast("bigint").alias("k"), F.round("value", 9).alias("value")
    )


POINTS = """points AS (
  SELECT vec_id AS experiment_id, CAST(label AS BIGINT) AS cluster, i - 1 AS idx, CAST(embedding[i] AS DOUBLE) AS value
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def _lerp_sql(source):
    return f"""ends AS (SELECT experiment_id, max(idx) + 1 AS n FROM {source} GROUP BY 1),
    places AS (SELECT experiment_id, n, k, k * (n - 1) / CAST({LAST} AS DOUBLE) AS p FROM ends, (SELECT unnest(range({CURVE_POINTS})) AS k)),
    lerped AS (SELECT a.experiment_id, a.k, round(CASE WHEN p = floor(p) THEN l.value ELSE l.value + (r.value - l.value) * (p - floor(p)) END, 9) + 0.0 AS value
      FROM places a JOIN {source} l ON l.experiment_id = a.experiment_id AND l.idx = floor(p)
      LEFT JOIN {source} r ON r.experiment_id = a.experiment_id AND r.idx = floor(p) + 1)"""


@query("resample_curve", f"WITH {POINTS}, {_lerp_sql('points')} SELECT * FROM lerped")
def resample_curve(spark, sf_dir):
    return samples_long(ops.resample_array(curves(spark, sf_dir)))


@query(
    "resample_grid_curve",
    f"""WITH {prepared_sql()}, signal AS (SELECT experiment_id, idx, value FROM prep WHERE feature = '{TEMPERATURE}'),
    {_lerp_sql('signal')} SELECT * FROM lerped""",
)
def resample_grid_curve(spark, sf_dir):
    return samples_long(ops.resample_curve(prepared(spark, sf_dir), TEMPERATURE))


DESCRIBED = """described AS (
  SELECT experiment_id, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
         quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS max
  FROM {source} GROUP BY 1)"""
NUMBERS = ("mean", "std", "min", "q25", "q50", "q75", "max")


DESCRIPTIONS = f"""WITH {prepared_sql()}, signal AS (SELECT experiment_id, value FROM prep WHERE feature = '{TEMPERATURE}'),
    {DESCRIBED.format(source='signal')}
    SELECT experiment_id, count, {", ".join(f'round({c}, 9) AS {c}' for c in NUMBERS)} FROM described"""


def _rounded(found):
    return found.select("experiment_id", "count", *[F.round(c, 9).alias(c) for c in NUMBERS])


@query("describe_experiments", DESCRIPTIONS)
def describe_experiments(spark, sf_dir):
    return _rounded(ops.describe(prepared(spark, sf_dir), TEMPERATURE, GRID.max_rows))


@query("describe_long_experiments", DESCRIPTIONS)
def describe_long_experiments(spark, sf_dir):
    """As if nothing limited an experiment's length."""
    return _rounded(ops.describe(prepared(spark, sf_dir), TEMPERATURE))


@query(
    "exact_quantiles",
    """SELECT event_type, round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.5), 6) AS q50,
      round(quantile_cont(value, 0.999), 6) AS q999 FROM events GROUP BY 1""",
)
def exact_quantiles(spark, sf_dir):
    """Of all readings of a channel, each far more than one task sorts here."""
    found = quantiles.exact_quantiles(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), [0.01, 0.5, 0.999], small=16)
    return found.select("event_type", *[F.round(F.get("quantiles", F.lit(k)), 6).alias(n) for k, n in enumerate(("q01", "q50", "q999"))])


SCORES = f"""WITH {POINTS}, {DESCRIBED.format(source='points')},
labels0 AS (SELECT vec_id AS experiment_id, CAST(label AS BIGINT) AS cluster FROM embeddings),
centred AS (SELECT cluster, experiment_id, mean, std, avg(mean) OVER (PARTITION BY cluster) AS cluster_mean,
              avg(std) OVER (PARTITION BY cluster) AS cluster_std FROM described JOIN labels0 USING (experiment_id)),
scores AS (SELECT cluster, experiment_id, ((mean - cluster_mean) ** 2 + (std - cluster_std) ** 2) / 2 AS score FROM centred),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score, experiment_id) AS rank FROM scores)"""


def scored(spark, sf_dir):
    return ops.cluster_scores(ops.describe(curve_grid(spark, sf_dir), "value", CURVE_ROWS), members(spark, sf_dir))


@query("cluster_scores", f"{SCORES} SELECT cluster, experiment_id, round(score, 12) AS score FROM scores")
def cluster_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("cluster", "experiment_id", F.round("score", 12).alias("score"))


@query("cluster_top_n", f"{SCORES} SELECT cluster, experiment_id, rank FROM ranked WHERE rank <= {TOP}")
def cluster_top_n(spark, sf_dir):
    return ops.cluster_top_n(scored(spark, sf_dir), TOP).select("cluster", "experiment_id", "rank")


@query(
    "select_top_experiments",
    f"{SCORES} SELECT experiment_id, idx, round(value, 9) + 0.0 AS value FROM points WHERE experiment_id IN (SELECT experiment_id FROM ranked WHERE rank <= {TOP})",
)
def select_top_experiments(spark, sf_dir):
    chosen = ops.select_experiments(curve_grid(spark, sf_dir), ops.cluster_top_n(scored(spark, sf_dir), TOP))
    return chosen.select("experiment_id", F.col("idx").cast("bigint").alias("idx"), F.round("value", 9).alias("value"))


@query(
    "cluster_members",
    f"""WITH every AS (SELECT unnest(range({EMPTY_TOO})) AS cluster),
    own AS (SELECT vec_id AS experiment_id, CAST(label AS BIGINT) AS cluster, count(*) OVER (PARTITION BY label) AS size FROM embeddings)
    SELECT cluster, experiment_id, coalesce(size, 0) AS size FROM every LEFT JOIN own USING (cluster)""",
)
def cluster_members(spark, sf_dir):
    return ops.cluster_members(members(spark, sf_dir), EMPTY_TOO)


def _silhouette_sql(distance, name):
    return f"""WITH own AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS cluster, CAST(embedding AS DOUBLE[]) AS curve FROM embeddings),
    spread AS (SELECT a.id, a.cluster, b.cluster AS other, sum({distance}) AS total, count(*) AS n
      FROM own a, own b GROUP BY 1, 2, 3),
    inner0 AS (SELECT id, cluster, CASE WHEN n > 1 THEN total / (n - 1) END AS own FROM spread WHERE cluster = other),
    outer0 AS (SELECT id, min(total / n) AS other FROM spread WHERE cluster <> other GROUP BY 1)
    SELECT id AS experiment_id, cluster, round(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END, 6) + 0.0 AS silhouette,
           '{name}' AS measure FROM inner0 JOIN outer0 USING (id)"""


EUCLIDEAN = _silhouette_sql("list_distance(a.curve, b.curve)", "euclidean")


@query("silhouette", EUCLIDEAN)
def silhouette(spark, sf_dir):
    found = cluster.silhouette(curves(spark, sf_dir))
    return found.withColumn("silhouette", F.round("silhouette", 6))


@query("silhouette_in_tiles", EUCLIDEAN)
def silhouette_in_tiles(spark, sf_dir):
    found = cluster.silhouette(curves(spark, sf_dir), tile_rows=200)
    return found.withColumn("silhouette", F.round("silhouette", 6))


@query("silhouette_mean", f"SELECT measure, round(avg(silhouette), 4) + 0.0 AS silhouette FROM ({EUCLIDEAN}) GROUP BY 1")
def silhouette_mean(spark, sf_dir):
    return cluster.mean_silhouette(cluster.silhouette(curves(spark, sf_dir))).withColumn("silhouette", F.round("silhouette", 4))


@query("silhouette_squared", _silhouette_sql("list_distance(a.curve, b.curve) ** 2", "squared_euclidean"))
def silhouette_squared(spark, sf_dir):
    found = cluster.silhouette_squared(curves(spark, sf_dir))
    return found.withColumn("silhouette", F.round("silhouette", 6))


@query(
    "resize_plan",
    "WITH batches(batch, lo, hi) AS (VALUES ('all', 0, 9223372036854775807), "
    + ", ".join(f"('{b}', {lo}, {hi})" for b, (lo, hi) in EXPERIMENT_BATCHES.items())
    + """), sizes AS (SELECT batch, count(DISTINCT user_id) AS experiments FROM batches LEFT JOIN events ON user_id BETWEEN lo AND hi GROUP BY 1)
    SELECT batch, experiments, CASE WHEN experiments < 20 THEN 'augment' WHEN experiments > 100 THEN 'cluster' ELSE 'keep' END AS action,
      CAST(CASE WHEN experiments < 20 THEN 20 - experiments WHEN experiments > 100 THEN greatest(100 // 6, 1) ELSE 0 END AS BIGINT) AS amount
    FROM sizes""",
)
def resize_plan(spark, sf_dir):
    ids = readings(spark, sf_dir).select("experiment_id").distinct().withColumn("found", F.lit(1))
    sizes = (
        gates.expand_batches(gates.batch_table(spark), ids).join(ids, "experiment_id", "left")
        .groupBy("batch").agg(F.count("found").alias("experiments"))
    )
    action, amount = ops.resize_decision(F.col("experiments"), 20, 100, 6)
    return sizes.select("batch", "experiments", action.alias("action"), amount.alias("amount"))


@query(
    "experiments_digest",
    f"""WITH ids AS (SELECT DISTINCT user_id FROM events),
    ranges AS (SELECT user_id // {ops.RANGE_IDS} AS part, md5(string_agg(CAST(user_id AS VARCHAR), chr(10) ORDER BY user_id)) AS d FROM ids GROUP BY 1)
    SELECT md5(string_agg(d, chr(10) ORDER BY part)) AS digest FROM ranges""",
)
def experiments_digest(spark, sf_dir):
    return ops.experiments_digest(readings(spark, sf_dir))


@query(
    "experiments_list_digest",
    "SELECT md5(string_agg(CAST(user_id AS VARCHAR), chr(10) ORDER BY user_id)) AS digest FROM (SELECT DISTINCT user_id FROM events)",
)
def experiments_list_digest(spark, sf_dir):
    return ops.list_digest(readings(spark, sf_dir))


# --- augmentation -----------------------------------------------------------------


def _uniform_sql(text):
    return f"((CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"


def _gauss_sql(prefix):
    radius = f"{prefix} || '|radius'"
    angle = f"{prefix} || '|angle'"
    return f"(sqrt(-2 * ln({_uniform_sql(radius)})) * cos(2 * pi() * {_uniform_sql(angle)}))"


PICK = f"sample || '|{SEED}|pick'"
NOISE = _gauss_sql(f"p.sample || '|' || g.idx || '|' || g.feature || '|{SEED}'")


def jittered_sql(samples):
    """The synthetic experiments; samples is how many, in SQL."""
    return f"""WITH {prepared_sql()},
ids AS (SELECT experiment_id, row_number() OVER (ORDER BY md5(experiment_id || '|{SEED}'), experiment_id) - 1 AS pick,
               count(*) OVER () AS n, max(experiment_id) OVER () AS largest FROM (SELECT DISTINCT experiment_id FROM prep)),
drawn AS (SELECT sample, CAST(floor({_uniform_sql(PICK)} * (SELECT min(n) FROM ids)) AS BIGINT) AS pick FROM (SELECT unnest(range({samples})) AS sample)),
picks AS (SELECT sample, experiment_id, CASE WHEN largest < 2000 THEN 2000 ELSE largest + 1 END + sample AS synthetic FROM drawn JOIN ids USING (pick)),
noisy AS (SELECT p.synthetic AS experiment_id, g.idx, g.feature, g.value + CAST({JITTER_LEVEL} AS DOUBLE) * {NOISE} AS value
  FROM picks p JOIN prep g ON g.experiment_id = p.experiment_id),
jittered AS (SELECT experiment_id, idx, feature, avg(value) OVER (PARTITION BY experiment_id, feature ORDER BY idx
  ROWS BETWEEN {SMOOTHING - 1} PRECEDING AND CURRENT ROW) AS value FROM noisy)"""


JITTERED = jittered_sql(SAMPLES)


def jittered(spark, sf_dir):
    return augment.jitter(prepared(spark, sf_dir), FEATURES, SAMPLES, SMOOTHING, seed=SEED, max_rows=GRID.max_rows)


@query("jitter_augment", f"{JITTERED} SELECT experiment_id, idx, feature, round(value, 8) + 0.0 AS value FROM jittered")
def jitter_augment(spark, sf_dir):
    return long_form(jittered(spark, sf_dir), FEATURES, digits=8)


@query(
    "augment_union",
    f"""{JITTERED}, both0 AS (SELECT experiment_id, idx, feature, value FROM prep
      UNION ALL SELECT experiment_id, idx, feature, value FROM jittered)
    SELECT experiment_id, idx, feature, round(value, 8) + 0.0 AS value FROM both0""",
)
def augment_union(spark, sf_dir):
    both = augment.with_samples(prepared(spark, sf_dir), jittered(spark, sf_dir))
    return long_form(both, FEATURES, digits=8)


# --- clustering -------------------------------------------------------------------


WARPED = 12
FIXED = (3, 50, 111)
SAMPLE_AT = f"k * (len(c) - 1) / CAST({WARPED - 1} AS DOUBLE)"
# a row of accumulated costs is folded from the costs of its points and the row before
ASSIGNED = f"""WITH RECURSIVE own AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS c FROM embeddings),
short AS (SELECT id, list_transform(range({WARPED}), lambda k: c[floor({SAMPLE_AT})::BIGINT + 1] + CASE WHEN floor({SAMPLE_AT}) = {SAMPLE_AT} THEN 0
    ELSE (c[floor({SAMPLE_AT})::BIGINT + 2] - c[floor({SAMPLE_AT})::BIGINT + 1]) * ({SAMPLE_AT} - floor({SAMPLE_AT})) END) AS x FROM own),
centres AS (SELECT x AS y, row_number() OVER (ORDER BY id) - 1 AS cluster FROM short WHERE id IN {FIXED}),
warp AS (SELECT id, cluster, x, y, 0 AS i, list_concat([0::DOUBLE], list_transform(range({WARPED}), lambda j: 'inf'::DOUBLE)) AS r FROM short, centres
  UNION ALL SELECT id, cluster, x, y, i + 1, list_reduce(list_transform(range(1, {WARPED} + 1),
      lambda j: [(x[i + 1] - y[j]) * (x[i + 1] - y[j]), r[j], r[j + 1]]),
    lambda a, e: list_append(a, e[1] + least(e[2], e[3], a[len(a)])
      - ln(exp(least(e[2], e[3], a[len(a)]) - e[2]) + exp(least(e[2], e[3], a[len(a)]) - e[3]) + exp(least(e[2], e[3], a[len(a)]) - a[len(a)]))),
    ['inf'::DOUBLE]) FROM warp WHERE i < {WARPED}),
apart AS (SELECT id, cluster, r[{WARPED + 1}] AS distance FROM warp WHERE i = {WARPED})
SELECT id AS experiment_id, arg_min(cluster, (distance, cluster)) AS cluster, round(min(distance), 6) + 0.0 AS distance FROM apart GROUP BY 1"""


@query("cluster_assign", ASSIGNED)
def cluster_assign(spark, sf_dir):
    """The nearest of three given curves under soft-DTW."""
    short = ops.resample_array(curves(spark, sf_dir), WARPED)
    centres = short.where(F.col("experiment_id").isin(*FIXED)).orderBy("experiment_id").select("curve").collect()
    found = cluster.assign(short.select("experiment_id", "curve"), np.array([r["curve"] for r in centres]))
    return found.withColumn("distance", F.round("distance", 6))


@query("cluster_curves")
def cluster_curves(spark, sf_dir):
    short = ops.resample_array(curves(spark, sf_dir))
    return cluster.soft_dtw_kmeans(short, CLUSTERS).members


@query("cluster_select")
def cluster_select(spark, sf_dir):
    return cluster.cluster_select(keep(prepared(spark, sf_dir), "grid"), 6, 2, max_rows=GRID.max_rows).members
