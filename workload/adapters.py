"""The given tables seen as the domain's tables, for Spark and as SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.settings import DatasetSpec, Grid, WindowSpec

# event types as channels: a process profile, and a profile of particle counts
PROCESS = {
    "click": ("sensor", "intensity"),
    "error": ("sensor", "temperature"),
    "purchase": ("ftir", "concentration"),
    "signup": ("ftir", "temperature"),
    "view": ("fbrm", "counts_10-50"),
}
BINS = {
    "click": ("fbrm", "counts_10"),
    "error": ("fbrm", "counts_10-50"),
    "purchase": ("fbrm", "counts_50-150"),
    "signup": ("fbrm", "counts_150-300"),
    "view": ("thermostat", "temperature_process"),
}
RANGES = {
    "sensor:intensity": (0.0, 200.0),
    "sensor:temperature": (0.0, 75.0),
    "ftir:concentration": (0.0, 400.0),
    "ftir:temperature": (0.0, 75.0),
    "fbrm:counts_10-50": (0.0, 200.0),
    "fe:supersaturation": (0.0, 5.0),
}
FEATURES = ("sensor:intensity", "sensor:temperature", "ftir:concentration", "ftir:temperature", "fbrm:counts_10-50")
BIN_FEATURES = ("fbrm:counts_10", "fbrm:counts_10-50", "fbrm:counts_50-150", "fbrm:counts_150-300")
BIN_RANGES = {f: (0.0, 300.0) for f in BIN_FEATURES} | {"thermostat:temperature_process": (5.0, 75.0)}

CHUNK = 21_600
SPAN = 31 * 86_400
GRID = Grid(chunk_seconds=CHUNK, max_duration_s=SPAN)
SMOOTHING = 5
SPEC = DatasetSpec(
    history=FEATURES,
    prediction=("sensor:intensity",),
    controlled=("ftir:temperature",),
    ranges=RANGES,
    substance=None,
    grid=GRID,
    smoothing=SMOOTHING,
)
WINDOWS = WindowSpec(
    history=("sensor:intensity", "sensor:temperature"),
    prediction=("sensor:intensity",),
    controlled=("ftir:temperature",),
    steps_history=4,
    steps_prediction=3,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str, profile: dict = PROCESS, by_day: bool = False) -> DataFrame:
    """events as raw readings; by_day makes each user's day an experiment of its own."""
    events = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    experiment = F.col("user_id") * 100 + F.dayofmonth(ts) if by_day else F.col("user_id")
    device = F.lit(None).cast("string")
    channel = F.lit(None).cast("string")
    for event, (dev, chan) in profile.items():
        device = F.when(F.col("event_type") == event, F.lit(dev)).otherwise(device)
        channel = F.when(F.col("event_type") == event, F.lit(chan)).otherwise(channel)
    return events.select(
        experiment.alias("experiment_id"),
        substance_of(F.col("user_id")).alias("substance"),
        device.alias("device"),
        channel.alias("channel"),
        ts.alias("ts"),
        "value",
    )


def substance_of(number):
    return F.when(number % 2 == 0, F.lit("aa")).otherwise(F.lit("pdp"))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as curves of doubles with a reference cluster."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("experiment_id"),
        F.col("embedding").cast("array<double>").alias("curve"),
        F.col("label").alias("cluster"),
    )


def long_form(grid: DataFrame, features, digits: int = 9, keep: tuple[str, ...] = ("experiment_id", "idx")) -> DataFrame:
    """Rounded values of the named columns, one row per key and feature."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.round(F.col(f"`{f}`"), digits).alias("value")) for f in features]
    )
    return grid.select(*keep, F.inline(pairs))


# --- SQL ----------------------------------------------------------------------


def readings_sql(profile: dict = PROCESS, by_day: bool = False) -> str:
    experiment = "user_id * 100 + day(ts)" if by_day else "user_id"
    cases = " ".join(f"WHEN '{e}' THEN '{d}:{c}'" for e, (d, c) in profile.items())
    return (
        f"readings AS (SELECT {experiment} AS experiment_id, "
        "CASE WHEN user_id % 2 = 0 THEN 'aa' ELSE 'pdp' END AS substance, "
        f"CASE event_type {cases} END AS feature, epoch_us(ts) AS us, ts, value FROM events)"
    )


def ranges_sql(ranges: dict) -> str:
    rows = ", ".join(f"('{f}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for f, (lo, hi) in ranges.items())
    return f"ranges(feature, lo, hi) AS (VALUES {rows})"


def grid_sql(
    profile: dict = PROCESS,
    ranges: dict = RANGES,
    features=FEATURES,
    outliers: bool = True,
    chunk: int = CHUNK,
    by_day: bool = False,
    max_s: int = SPAN,
) -> str:
    """CTEs readings, ranges, ext and grid (long: experiment_id, idx, us, n_points, feature, value)."""
    value = "CASE WHEN r.value > g.lo AND r.value < g.hi THEN r.value END" if outliers else "r.value"
    wanted = ", ".join(f"('{f}')" for f in features)
    chunk_us = chunk * 1_000_000
    names = ", ".join(f"'{f}'" for f in features)
    return f"""
{readings_sql(profile, by_day)},
{ranges_sql(ranges)},
wanted(feature) AS (VALUES {wanted}),
taken AS (SELECT * FROM readings WHERE feature IN ({names})),
ext0 AS (SELECT experiment_id, min(us) AS first_us, max(us) AS last_us FROM taken GROUP BY 1),
ext AS (
  SELECT *, (last_us - first_us) // 60000000 AS minutes,
         (last_us - first_us) // 60000000 * 60 // {chunk} AS n_points,
         first_us // {chunk_us} AS b0, last_us // {chunk_us} AS b1
  FROM ext0
),
good AS (SELECT * FROM ext WHERE n_points >= 1 AND minutes * 60 <= {max_s}),
means AS (
  SELECT r.experiment_id, r.feature, r.us // {chunk_us} AS bin, avg({value}) AS value
  FROM taken r JOIN ranges g ON g.feature = r.feature GROUP BY 1, 2, 3
),
spine AS (
  SELECT experiment_id, n_points, b0, unnest(range(b0, b1 + 1)) AS bin FROM good
),
grid AS (
  SELECT s.experiment_id, s.bin - s.b0 AS idx, s.bin * {chunk_us} AS us, s.n_points, w.feature, m.value
  FROM spine s CROSS JOIN wanted w
  LEFT JOIN means m ON m.experiment_id = s.experiment_id AND m.bin = s.bin AND m.feature = w.feature
)"""


def prepared_sql(smoothing: int = SMOOTHING, **options) -> str:
    """CTEs up to prep: the grid normalized, filled, smoothed and trimmed (long)."""
    return f"""{grid_sql(**options)},
scaled AS (
  SELECT g.*, (g.value - r.lo) / (r.hi - r.lo) AS norm FROM grid g JOIN ranges r ON r.feature = g.feature
),
filled AS (
  SELECT experiment_id, idx, us, n_points, feature,
    coalesce(last_value(norm IGNORE NULLS) OVER (PARTITION BY experiment_id, feature ORDER BY idx
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(norm IGNORE NULLS) OVER (PARTITION BY experiment_id, feature ORDER BY idx
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
  FROM scaled
),
smooth AS (
  SELECT experiment_id, idx, us, n_points, feature,
    avg(value) OVER (PARTITION BY experiment_id, feature ORDER BY idx
      ROWS BETWEEN {smoothing // 2} PRECEDING AND {(smoothing - 1) // 2} FOLLOWING) AS value
  FROM filled
),
prep AS (SELECT * FROM smooth WHERE idx < n_points)"""


def wide_sql(source: str, features, name: str = "wide") -> str:
    """A CTE with one column per feature, from a long one."""
    picks = ", ".join(f"max(value) FILTER (WHERE feature = '{f}') AS \"{f}\"" for f in features)
    return f"{name} AS (SELECT experiment_id, idx, min(us) AS us, min(n_points) AS n_points, {picks} FROM {source} GROUP BY 1, 2)"
