"""Queries over readings and grids."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sensorloom.functions import names, physics
from sensorloom.operators import features as feature_ops
from sensorloom.operators import gates, resample, series
from sensorloom.plans.preparation import denormalize_grid, normalize_grid, preprocess
from sensorloom.session import fresh_path
from sensorloom.settings import DEFAULT_RANGES, EXPERIMENT_BATCHES, FAULTY_EXPERIMENTS, Grid
from sensorloom.sources import dataset as storage
from sensorloom.sources import readings as source
from workload.adapters import (
    BINS,
    FEATURES,
    GRID,
    RANGES,
    SMOOTHING,
    SPEC,
    grid_sql,
    long_form,
    prepared_sql,
    ranges_sql,
    readings,
    readings_sql,
    substance_of,
    table,
    wide_sql,
)
from workload.registry import query

LONG = "SELECT experiment_id, idx, feature, round(value, 9) + 0.0 AS value FROM"


def us():
    return F.unix_micros("ts").alias("us")


DAILY = Grid()
LIMIT = GRID.max_rows


def process_readings(spark, sf_dir, by_day=False):
    return source.scan_features(readings(spark, sf_dir, by_day=by_day), list(FEATURES))


def raw_grid(spark, sf_dir):
    return resample.resample_mean(process_readings(spark, sf_dir), FEATURES, GRID)


def clean_grid(spark, sf_dir):
    return resample.resample_mean(process_readings(spark, sf_dir), FEATURES, GRID, RANGES)


def prepared(spark, sf_dir):
    return preprocess(process_readings(spark, sf_dir), SPEC)


# --- scans ----------------------------------------------------------------------


@query(
    "scan_readings",
    f"""WITH {readings_sql()}
    SELECT experiment_id, feature, us, value FROM readings
    WHERE feature = 'sensor:intensity' AND substance = 'aa' AND ts >= TIMESTAMP '2020-10-19 00:00:00'""",
)
def scan_readings(spark, sf_dir):
    found = source.scan(readings(spark, sf_dir), device="sensor", channel="intensity", substance="aa")
    return found.select("experiment_id", "feature", us(), "value")


@query(
    "scan_required_features",
    f"""WITH {readings_sql()}
    SELECT experiment_id, feature, us, value FROM readings
    WHERE feature IN ('sensor:intensity', 'sensor:temperature', 'ftir:concentration', 'ftir:temperature')""",
)
def scan_required_features(spark, sf_dir):
    wanted = feature_ops.required_features(
        ("sensor:intensity",), (), ("fe:supersaturation", "fe:nucleation_temperature", "fix:stirrer=200")
    )
    found = source.scan_features(readings(spark, sf_dir), wanted)
    return found.select("experiment_id", "feature", us(), "value")


@query(
    "alias_filter",
    f"""WITH {readings_sql(BINS)}
    SELECT experiment_id, feature, count(*) AS points, round(sum(value), 6) AS total FROM readings
    WHERE feature = 'fbrm:counts_10-50' AND substance = 'pdp' GROUP BY 1, 2""",
)
def alias_filter(spark, sf_dir):
    """Half of the rows carry the alias spellings of channel and substance."""
    event = table(spark, sf_dir, "events")
    own = readings(spark, sf_dir, BINS)
    odd = F.pmod(F.xxhash64("ts", "value"), F.lit(2)) == 1
    channel = F.col("channel")
    for short, alias in (("counts_10", "counts, No Wt, <10 (Primary)"), ("counts_10-50", "counts, No Wt, 10-50 (Primary)")):
        channel = F.when(odd & (F.col("channel") == short), F.lit(alias)).otherwise(channel)
    substance = F.when(odd & (F.col("substance") == "pdp"), F.lit("kdp")).otherwise(F.col("substance"))
    spelled = own.withColumn("channel", channel).withColumn("substance", substance)
    found = source.scan(spelled, device="fbrm", channel="counts_10-50", substance="pdp")
    return found.groupBy("experiment_id", "feature").agg(
        F.count("*").alias("points"), F.round(F.sum("value"), 6).alias("total")
    )


def _stored(spark, sf_dir):
    grid = prepared(spark, sf_dir)
    path = fresh_path(spark, "dataset")
    storage.write_dataset(grid, path)
    return path, grid.schema


@query("write_dataset", f"WITH {prepared_sql()} {LONG} prep")
def write_dataset(spark, sf_dir):
    path, schema = _stored(spark, sf_dir)
    return long_form(storage.read_dataset(spark, path, schema), FEATURES)


FAULTY = ", ".join(str(i) for i in FAULTY_EXPERIMENTS)


@query(
    "read_dataset",
    f"WITH {prepared_sql()} {LONG} prep WHERE experiment_id NOT IN ({FAULTY})",
)
def read_dataset(spark, sf_dir):
    path, schema = _stored(spark, sf_dir)
    listed = gates.choose_experiments(spark, "all", readings(spark, sf_dir))
    return long_form(storage.read_dataset(spark, path, schema, listed), FEATURES)


DAMAGED = 3
GROUPS_OF = 10
ABSENT = 99_999_999


def damaged(spark, sf_dir):
    """A stored data set of which one folder no longer holds what was written, read by a list with an id that was never stored."""
    grid = prepared(spark, sf_dir)
    path = fresh_path(spark, "damaged")
    storage.write_dataset(grid, path, GROUPS_OF)
    broken = f"{path}/{storage.GROUP}={DAMAGED}"
    spark.range(1).select(F.lit("not a table").alias("value")).write.mode("overwrite").text(broken)
    absent = spark.range(ABSENT, ABSENT + 1).select(F.col("id").alias("experiment_id"))
    listed = readings(spark, sf_dir).select("experiment_id").distinct().unionByName(absent)
    return path, grid.schema, listed


@query("read_dataset_damaged", f"WITH {prepared_sql()} {LONG} prep WHERE experiment_id // {GROUPS_OF} <> {DAMAGED}")
def read_dataset_damaged(spark, sf_dir):
    return long_form(storage.read_checked(spark, *damaged(spark, sf_dir), GROUPS_OF).grid, FEATURES)


@query(
    "read_rejects",
    f"""WITH {prepared_sql()}, sizes AS (SELECT experiment_id, count(*) AS n FROM prep WHERE feature = 'sensor:intensity' GROUP BY 1)
    SELECT user_id AS experiment_id, 'read' AS stage, CASE WHEN n IS NULL THEN 'no data set' ELSE '0 of ' || n || ' rows readable' END AS reason
    FROM (SELECT DISTINCT user_id FROM events UNION ALL SELECT {ABSENT}) LEFT JOIN sizes ON user_id = experiment_id
    WHERE n IS NULL OR user_id // {GROUPS_OF} = {DAMAGED}""",
)
def read_rejects(spark, sf_dir):
    return storage.read_checked(spark, *damaged(spark, sf_dir), GROUPS_OF).rejects


@query("experiment_list", "SELECT DISTINCT user_id AS experiment_id FROM events")
def experiment_list(spark, sf_dir):
    """Written, read again, joined by lines with line ends and blank ones."""
    ids = readings(spark, sf_dir).select("experiment_id").distinct()
    path = fresh_path(spark, "experiments")
    storage.write_experiment_list(ids, path)
    lines = spark.read.text(path)
    noisy = lines.select(F.concat("value", F.lit("\r")).alias("value")).union(lines.select(F.lit(" \r").alias("value")))
    return storage.parse_experiment_list(noisy, "value")


@query(
    "norm_ranges",
    f"""WITH {readings_sql(BINS)}, {ranges_sql(DEFAULT_RANGES)}
    SELECT f.feature, r.lo, r.hi FROM (SELECT DISTINCT feature FROM readings) f LEFT JOIN ranges r USING (feature)""",
)
def norm_ranges(spark, sf_dir):
    used = readings(spark, sf_dir, BINS).select(F.concat_ws(":", "device", "channel").alias("feature")).distinct()
    return used.join(resample.norm_ranges(spark), "feature", "left")


@query(
    "role_projection",
    f"""WITH {prepared_sql()}, {wide_sql('prep', FEATURES)}
    SELECT experiment_id, idx, round("sensor:intensity", 9) AS intensity, round("ftir:temperature", 9) AS temperature FROM wide""",
)
def role_projection(spark, sf_dir):
    chosen = storage.project(prepared(spark, sf_dir), ("sensor:intensity", "ftir:temperature"))
    return chosen.select(
        "experiment_id",
        "idx",
        F.round(names.col("sensor:intensity"), 9).alias("intensity"),
        F.round(names.col("ftir:temperature"), 9).alias("temperature"),
    )


# --- choice of experiments --------------------------------------------------------


@query(
    "expand_batch",
    "WITH batches(batch, lo, hi) AS (VALUES ('all', 0, 9223372036854775807), "
    + ", ".join(f"('{b}', {lo}, {hi})" for b, (lo, hi) in EXPERIMENT_BATCHES.items())
    + """)
    SELECT b.batch, e.user_id AS experiment_id, count(*) AS points
    FROM batches b JOIN events e ON e.user_id BETWEEN b.lo AND b.hi GROUP BY 1, 2""",
)
def expand_batch(spark, sf_dir):
    ids = gates.expand_batches(gates.batch_table(spark), readings(spark, sf_dir))
    return readings(spark, sf_dir).join(ids, "experiment_id").groupBy("batch", "experiment_id").agg(
        F.count("*").alias("points")
    )


@query("exclude_faulty", f"SELECT DISTINCT user_id AS experiment_id FROM events WHERE user_id NOT IN ({FAULTY}) ORDER BY 1")
def exclude_faulty(spark, sf_dir):
    return gates.exclude_faulty(readings(spark, sf_dir), gates.faulty_table(spark))


@query(
    "null_outliers",
    f"""WITH {readings_sql()}, {ranges_sql(RANGES)}
    SELECT experiment_id, r.feature, us, CASE WHEN value > lo AND value < hi THEN value END AS value
    FROM readings r JOIN ranges g ON g.feature = r.feature""",
)
def null_outliers(spark, sf_dir):
    return resample.null_outliers(process_readings(spark, sf_dir), RANGES).select("experiment_id", "feature", us(), "value")


@query(
    "outlier_share",
    f"""WITH {readings_sql()}, {ranges_sql(RANGES)},
    aligned AS (SELECT experiment_id, count(DISTINCT us) AS aligned_rows FROM readings GROUP BY 1),
    counts AS (
      SELECT experiment_id, r.feature, count(*) AS points,
             count(*) FILTER (WHERE NOT (value > lo AND value < hi)) AS removed
      FROM readings r JOIN ranges g ON g.feature = r.feature GROUP BY 1, 2)
    SELECT experiment_id, feature, aligned_rows, aligned_rows - points AS missing_before,
           aligned_rows - points + removed AS missing_after,
           round(removed * CAST(100 AS DOUBLE) / aligned_rows, 9) AS outlier_percent,
           removed * CAST(100 AS DOUBLE) / aligned_rows > 10 AS alert
    FROM counts JOIN aligned USING (experiment_id)""",
)
def outlier_share(spark, sf_dir):
    found = resample.outlier_share(process_readings(spark, sf_dir), RANGES)
    return found.withColumn("outlier_percent", F.round("outlier_percent", 9))


EXTENT = f"""WITH {readings_sql(by_day=True)},
ext0 AS (SELECT experiment_id, min(us) AS first_us, max(us) AS last_us FROM readings GROUP BY 1),
ext AS (SELECT *, (last_us - first_us) // 60000000 AS minutes,
               (last_us - first_us) // 60000000 * 6 AS n_points FROM ext0)"""


@query("experiment_extent", EXTENT + " SELECT experiment_id, first_us, last_us, minutes, n_points FROM ext")
def experiment_extent(spark, sf_dir):
    return resample.experiment_extent(process_readings(spark, sf_dir, by_day=True), DAILY)


GATE = "CASE WHEN minutes * 60 > 172800 THEN 'too long' WHEN n_points < 1 THEN 'too short' END"


@query(
    "duration_gate",
    f"""WITH {readings_sql(by_day=True)},
    histories AS (SELECT experiment_id, us FROM readings UNION ALL SELECT -1 - experiment_id // 100, us FROM readings),
    ext AS (SELECT experiment_id, (max(us) - min(us)) // 60000000 AS minutes,
                   (max(us) - min(us)) // 60000000 * 6 AS n_points FROM histories GROUP BY 1)
    SELECT experiment_id, minutes, {GATE} AS reason FROM ext""",
)
def duration_gate(spark, sf_dir):
    """Days and whole histories as experiments, so that both limits are met and broken."""
    days = process_readings(spark, sf_dir, by_day=True)
    long = days.withColumn("experiment_id", -1 - F.call_function("div", F.col("experiment_id"), F.lit(100).cast("long")))
    extent = resample.experiment_extent(days.unionByName(long), DAILY)
    rejects = gates.out_of_limits(extent, DAILY).select("experiment_id", "reason")
    return extent.select("experiment_id", "minutes").join(rejects, "experiment_id", "left")


@query(
    "completeness_gate",
    f"""WITH {readings_sql(by_day=True)}
    SELECT experiment_id, count(*) AS points FROM readings GROUP BY 1 HAVING count(DISTINCT feature) = {len(FEATURES)}""",
)
def completeness_gate(spark, sf_dir):
    points = process_readings(spark, sf_dir, by_day=True)
    extent = resample.experiment_extent(points, DAILY, FEATURES)
    counts = points.groupBy("experiment_id").agg(F.count("*").alias("points"))
    return gates.accept(counts, gates.incomplete(extent, FEATURES))


@query(
    "range_gate",
    f"""WITH {readings_sql(by_day=True)}
    SELECT DISTINCT experiment_id FROM readings
    WHERE experiment_id NOT IN (SELECT experiment_id FROM readings WHERE feature = 'ftir:concentration')""",
)
def range_gate(spark, sf_dir):
    points = process_readings(spark, sf_dir, by_day=True)
    known = {f: limits for f, limits in RANGES.items() if f != "ftir:concentration"}
    rejects = gates.without_range(points, resample.norm_ranges(spark, known))
    return gates.accept(points.select("experiment_id").distinct(), rejects)


@query(
    "parse_feature",
    """WITH named AS (
      SELECT DISTINCT CASE event_type WHEN 'click' THEN 'fbrm:counts_10-50' WHEN 'error' THEN 'fix:load=' || CAST(value AS VARCHAR)
        WHEN 'purchase' THEN 'sensor intensity' WHEN 'signup' THEN 'ftir:' ELSE 'fe:run_' || CAST(user_id AS VARCHAR) END AS feature
      FROM events),
    checked AS (
      SELECT feature, regexp_matches(feature, '^[a-zA-Z0-9_-]+:[a-zA-Z0-9_-]+$')
        OR regexp_matches(feature, '^fix:[a-zA-Z0-9_-]+=-?[0-9]+(\\.[0-9]+)?$') AS valid FROM named)
    SELECT feature, valid, CASE WHEN valid THEN split_part(feature, ':', 1) END AS device,
      CASE WHEN valid THEN split_part(feature, ':', 2) END AS channel,
      CASE WHEN feature LIKE 'fix:%' THEN CAST(split_part(feature, '=', 2) AS DOUBLE) END AS fixed
    FROM checked""",
)
def parse_feature(spark, sf_dir):
    event = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", F.lit("fbrm:counts_10-50"))
        .when(kind == "error", F.concat(F.lit("fix:load="), F.col("value").cast("string")))
        .when(kind == "purchase", F.lit("sensor intensity"))
        .when(kind == "signup", F.lit("ftir:"))
        .otherwise(F.concat(F.lit("fe:run_"), F.col("user_id").cast("string")))
    )
    found = feature_ops.parse_features(event.select(name.alias("feature")).distinct())
    return found.withColumn("fixed", names.fixed_value(F.col("feature")))


FIRST_MISSING = " ".join(
    f"WHEN NOT list_contains(found, '{f}') THEN 'no data for {f}'" for f in FEATURES
)


@query(
    "rejects",
    f"""{EXTENT},
    seen AS (SELECT experiment_id, list(DISTINCT feature) AS found FROM readings GROUP BY 1),
    judged AS (SELECT experiment_id, CASE {FIRST_MISSING} END AS scan, {GATE} AS gate FROM ext JOIN seen USING (experiment_id))
    SELECT experiment_id, CASE WHEN scan IS NOT NULL THEN 'scan' ELSE 'preprocess' END AS stage,
           coalesce(scan, gate) AS reason
    FROM judged WHERE scan IS NOT NULL OR gate IS NOT NULL""",
)
def rejects(spark, sf_dir):
    points = process_readings(spark, sf_dir, by_day=True)
    extent = resample.experiment_extent(points, DAILY, FEATURES)
    return gates.first_rejects(
        gates.incomplete(extent, FEATURES), gates.duplicated_readings(points), gates.out_of_limits(extent, DAILY)
    )


@query(
    "feature_set",
    f"""WITH {readings_sql()},
    roles AS (SELECT DISTINCT feature FROM readings WHERE feature LIKE 'fbrm:%'
      UNION SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'fe:supersaturation' ELSE 'fe:nucleation_temperature' END FROM events),
    deps(feature, requires) AS (VALUES ('fe:nucleation_temperature', 'sensor:intensity'), ('fe:nucleation_temperature', 'sensor:temperature'),
      ('fe:supersaturation', 'ftir:concentration'), ('fe:supersaturation', 'ftir:temperature')),
    total AS (SELECT feature FROM roles UNION SELECT requires FROM roles JOIN deps USING (feature))
    SELECT split_part(feature, ':', 1) AS device, string_agg(split_part(feature, ':', 2), ',' ORDER BY split_part(feature, ':', 2)) AS channels
    FROM total GROUP BY 1""",
)
def feature_set(spark, sf_dir):
    own = readings(spark, sf_dir)
    measured = own.where(F.col("device") == "fbrm").select(F.concat_ws(":", "device", "channel").alias("feature"))
    derived = own.select(
        F.when(F.col("experiment_id") % 2 == 0, F.lit("fe:supersaturation"))
        .otherwise(F.lit("fe:nucleation_temperature"))
        .alias("feature")
    )
    return feature_ops.feature_set(measured.union(derived), feature_ops.dependency_table(spark))


# --- alignment and grid -----------------------------------------------------------


@query(
    "align_channels",
    f"""WITH {readings_sql()}
    SELECT experiment_id, us, {", ".join(f"max(value) FILTER (WHERE feature = '{f}') AS {f.split(':')[0]}_{f.split(':')[1].replace('-', '_')}" for f in FEATURES)}
    FROM readings GROUP BY 1, 2""",
)
def align_channels(spark, sf_dir):
    aligned = resample.align_channels(process_readings(spark, sf_dir), FEATURES)
    return aligned.select(
        "experiment_id", us(), *[names.col(f).alias(f.replace(":", "_").replace("-", "_")) for f in FEATURES]
    )


@query("resample_mean", f"WITH {grid_sql(outliers=False)} {LONG} grid")
def resample_mean(spark, sf_dir):
    return long_form(raw_grid(spark, sf_dir), FEATURES)


@query("grid_times", f"WITH {grid_sql()} SELECT DISTINCT experiment_id, idx, us, n_points FROM grid")
def grid_times(spark, sf_dir):
    return clean_grid(spark, sf_dir).select("experiment_id", "idx", us(), "n_points")


ODD_CHUNK = 60_000_000_000 // 7


@query(
    "resample_odd_chunk",
    f"""WITH {readings_sql(by_day=True)},
    ext AS (SELECT experiment_id, min(us) AS first_us, max(us) AS last_us, epoch_us(date_trunc('day', min(ts))) AS day0
            FROM readings GROUP BY 1),
    good AS (SELECT * FROM ext WHERE (last_us - first_us) // 60000000 >= 1 AND (last_us - first_us) // 60000000 * 60 <= 172800)
    SELECT r.experiment_id, ((us - day0) * 1000) // {ODD_CHUNK} - ((first_us - day0) * 1000) // {ODD_CHUNK} AS idx, feature,
           round(avg(value), 9) AS value
    FROM readings r JOIN good USING (experiment_id) GROUP BY 1, 2, 3""",
)
def resample_odd_chunk(spark, sf_dir):
    """Seven points per minute, which do not divide a day; empty chunks are left out of the result."""
    grid = Grid(dps_per_minute=7)
    dense = resample.resample_mean(process_readings(spark, sf_dir, by_day=True), FEATURES, grid)
    return long_form(dense, FEATURES).where(F.col("value").isNotNull())


@query(
    "append_columns",
    f"""WITH {prepared_sql()}, {wide_sql('prep', FEATURES)}
    SELECT experiment_id, idx, round("ftir:concentration", 9) AS concentration,
           round("ftir:concentration" * 400, 9) AS concentration_raw FROM wide""",
)
def append_columns(spark, sf_dir):
    grid = prepared(spark, sf_dir).select("experiment_id", "idx", "`ftir:concentration`")
    raw = denormalize_grid(grid, ("ftir:concentration",), RANGES)
    both = series.append_columns(
        grid.withColumnRenamed("ftir:concentration", "concentration"),
        raw.withColumnRenamed("ftir:concentration", "concentration_raw"),
    )
    return both.select(
        "experiment_id", "idx", F.round("concentration", 9).alias("concentration"),
        F.round("concentration_raw", 9).alias("concentration_raw"),
    )


@query(
    "normalize",
    f"WITH {grid_sql()} SELECT experiment_id, idx, g.feature, round((value - lo) / (hi - lo), 9) AS value FROM grid g JOIN ranges USING (feature)",
)
def normalize(spark, sf_dir):
    return long_form(normalize_grid(clean_grid(spark, sf_dir), FEATURES, RANGES), FEATURES)


@query(
    "denormalize",
    f"WITH {prepared_sql()} SELECT experiment_id, idx, p.feature, round(value * (hi - lo) + lo, 9) AS value FROM prep p JOIN ranges USING (feature)",
)
def denormalize(spark, sf_dir):
    return long_form(denormalize_grid(prepared(spark, sf_dir), FEATURES, RANGES), FEATURES)


@query("fill_gaps", f"WITH {prepared_sql()} {LONG} filled")
def fill_gaps(spark, sf_dir):
    grid = normalize_grid(clean_grid(spark, sf_dir), FEATURES, RANGES)
    return long_form(series.fill_gaps(grid, FEATURES, LIMIT), FEATURES)


@query("fill_gaps_in_blocks", f"WITH {prepared_sql()} {LONG} filled")
def fill_gaps_in_blocks(spark, sf_dir):
    """The form for grids without a proven length, with blocks small enough to matter here."""
    grid = normalize_grid(clean_grid(spark, sf_dir), FEATURES, RANGES)
    return long_form(series.fill_gaps(grid, FEATURES, block_rows=16), FEATURES)


@query("smooth_centered", f"WITH {prepared_sql(smoothing=4)} {LONG} prep")
def smooth_centered(spark, sf_dir):
    grid = series.fill_gaps(normalize_grid(clean_grid(spark, sf_dir), FEATURES, RANGES), FEATURES, LIMIT)
    return long_form(series.smooth_centered(grid, FEATURES, 4, max_rows=LIMIT), FEATURES)


@query("smooth_centered_in_blocks", f"WITH {prepared_sql(smoothing=4)} {LONG} prep")
def smooth_centered_in_blocks(spark, sf_dir):
    grid = series.fill_gaps(normalize_grid(clean_grid(spark, sf_dir), FEATURES, RANGES), FEATURES, LIMIT)
    return long_form(series.smooth_centered(grid, FEATURES, 4, block_rows=16), FEATURES)


@query(
    "smooth_trailing",
    f"""WITH {prepared_sql()}
    SELECT experiment_id, idx, feature, round(avg(value) OVER (PARTITION BY experiment_id, feature ORDER BY idx
      ROWS BETWEEN {SMOOTHING - 1} PRECEDING AND CURRENT ROW), 9) AS value FROM prep""",
)
def smooth_trailing(spark, sf_dir):
    return long_form(series.smooth_trailing(prepared(spark, sf_dir), FEATURES, SMOOTHING, LIMIT), FEATURES)


@query("preprocess", f"WITH {prepared_sql()} {LONG} prep")
def preprocess_query(spark, sf_dir):
    return long_form(prepared(spark, sf_dir), FEATURES)


# --- derived features -------------------------------------------------------------

INTENSITY = """signal AS (SELECT experiment_id, idx, us, value AS x FROM prep WHERE feature = 'sensor:intensity')"""


def nucleation_sql(**options):
    return f"""WITH {prepared_sql(**options)}, {INTENSITY},
stepped AS (
  SELECT *, CASE WHEN idx = 0 THEN CASE WHEN x IS NOT NULL THEN 0.0 END
            ELSE x - lag(x) OVER (PARTITION BY experiment_id ORDER BY idx) END AS d,
         count(*) OVER (PARTITION BY experiment_id) AS n FROM signal),
rates AS (
  SELECT a.experiment_id, a.idx, min(a.us) AS us, min(a.n) AS n, round(avg(b.d), 12) AS rate
  FROM stepped a JOIN stepped b ON b.experiment_id = a.experiment_id
   AND b.idx BETWEEN a.idx - (a.n // 10) // 2 AND a.idx + (a.n // 10 - 1) // 2
  GROUP BY 1, 2),
prev AS (
  SELECT a.experiment_id, a.idx, avg(b.rate) AS before FROM rates a JOIN rates b
   ON b.experiment_id = a.experiment_id AND b.idx >= a.idx - a.n // 50 AND b.idx < a.idx GROUP BY 1, 2),
next AS (
  SELECT a.experiment_id, a.idx, avg(b.rate) AS after FROM rates a JOIN rates b
   ON b.experiment_id = a.experiment_id AND b.idx >= a.idx AND b.idx < a.idx + a.n // 50 GROUP BY 1, 2),
judged AS (
  SELECT r.*, r.n // 50 >= 1 AND r.idx > r.n // 50 AND r.idx < r.n - r.n // 50 AND r.rate > 0
      AND round(before, 12) < r.rate AND r.rate < round(after, 12) AND us // 60000000 % 60 >= 10 AS candidate,
    r.n // 50 >= 1 AND r.idx > r.n // 50 AND r.idx < r.n - r.n // 50 AND r.rate > 0
      AND round(before, 12) < r.rate AND r.rate < round(after, 12)
      AND us - min(us) OVER (PARTITION BY r.experiment_id) >= 600000000 AS elapsed
  FROM rates r LEFT JOIN prev USING (experiment_id, idx) LEFT JOIN next USING (experiment_id, idx))"""


NUCLEATION = nucleation_sql()
HALVES = Grid(chunk_seconds=5400, max_duration_s=GRID.max_duration_s)
BY_MINUTE = nucleation_sql(chunk=HALVES.chunk_seconds)


@query(
    "first_difference",
    f"""WITH {prepared_sql()}, {INTENSITY}
    SELECT experiment_id, idx, round(CASE WHEN idx = 0 THEN CASE WHEN x IS NOT NULL THEN 0.0 END
      ELSE x - lag(x) OVER (PARTITION BY experiment_id ORDER BY idx) END, 9) + 0.0 AS step FROM signal""",
)
def first_difference(spark, sf_dir):
    found = series.first_difference(prepared(spark, sf_dir), "sensor:intensity", "step", LIMIT)
    return found.select("experiment_id", "idx", F.round("step", 9).alias("step"))


@query(
    "nucleation_candidates",
    f"{NUCLEATION} SELECT experiment_id, idx, rate + 0.0 AS rate, coalesce(elapsed, false) AS candidate FROM judged",
)
def nucleation_candidates(spark, sf_dir):
    found = feature_ops.nucleation_candidates(prepared(spark, sf_dir), mode="elapsed", max_rows=LIMIT)
    return found.select("experiment_id", "idx", "rate", "candidate")


POINT = """point AS (SELECT experiment_id, arg_min(idx, (-rate, idx)) AS idx FROM judged WHERE {flag} GROUP BY 1)"""


@query(
    "nucleation_point",
    f"{NUCLEATION}, {POINT.format(flag='elapsed')} SELECT experiment_id, idx FROM point",
)
def nucleation_point(spark, sf_dir):
    found = feature_ops.nucleation_candidates(prepared(spark, sf_dir), mode="elapsed", max_rows=LIMIT)
    return feature_ops.nucleation_point(found).select("experiment_id", "idx")


@query(
    "nucleation_point_in_blocks",
    f"{NUCLEATION}, {POINT.format(flag='elapsed')} SELECT experiment_id, idx FROM point",
)
def nucleation_point_in_blocks(spark, sf_dir):
    found = feature_ops.nucleation_candidates(prepared(spark, sf_dir), mode="elapsed", block_rows=16)
    return feature_ops.nucleation_point(found).select("experiment_id", "idx")


def half_hours(spark, sf_dir):
    """On a grid of hours and a half, every other point of which lies in the first ten minutes of an hour."""
    return preprocess(process_readings(spark, sf_dir), replace(SPEC, grid=HALVES))


@query(
    "nucleation_candidates_by_minute",
    f"{BY_MINUTE} SELECT experiment_id, idx, rate + 0.0 AS rate, coalesce(candidate, false) AS candidate FROM judged",
)
def nucleation_candidates_by_minute(spark, sf_dir):
    """The default way: the first minutes of every hour do not count."""
    found = feature_ops.nucleation_candidates(half_hours(spark, sf_dir), max_rows=HALVES.max_rows)
    return found.select("experiment_id", "idx", "rate", "candidate")


@query(
    "nucleation_point_by_minute",
    f"{BY_MINUTE}, {POINT.format(flag='candidate')} SELECT experiment_id, idx FROM point",
)
def nucleation_point_by_minute(spark, sf_dir):
    found = feature_ops.nucleation_candidates(half_hours(spark, sf_dir), max_rows=HALVES.max_rows)
    return feature_ops.nucleation_point(found).select("experiment_id", "idx")


@query(
    "fe_nucleation_temperature",
    f"""{NUCLEATION}, {POINT.format(flag='elapsed')},
    heat AS (SELECT p.experiment_id, round(h.value, 9) AS temperature FROM point p JOIN prep h
      ON h.experiment_id = p.experiment_id AND h.idx = p.idx AND h.feature = 'sensor:temperature')
    SELECT s.experiment_id, s.idx, h.temperature FROM signal s LEFT JOIN heat h USING (experiment_id)""",
)
def fe_nucleation_temperature(spark, sf_dir):
    found = feature_ops.nucleation_temperature(prepared(spark, sf_dir), "elapsed", LIMIT)
    return found.select(
        "experiment_id", "idx", F.round(names.col("fe:nucleation_temperature"), 9).alias("temperature")
    )


SUBSTANCE = "CASE WHEN experiment_id % 2 = 0 THEN 'aa' ELSE 'pdp' END"
SATURATED = f"""WITH {prepared_sql()}, {wide_sql('prep', FEATURES)},
physical AS (
  SELECT experiment_id, idx, {SUBSTANCE} AS substance, "ftir:concentration" * 400 AS c, "ftir:temperature" * 75 AS t FROM wide),
saturated AS (
  SELECT *, CASE WHEN substance = 'aa' THEN CAST(13.505 AS DOUBLE) * exp(CAST(0.0418 AS DOUBLE) * t)
    ELSE (CAST(4.6479e-5 AS DOUBLE) * (t + CAST(273.15 AS DOUBLE)) * (t + CAST(273.15 AS DOUBLE))
          - CAST(0.022596 AS DOUBLE) * (t + CAST(273.15 AS DOUBLE)) + CAST(2.8535 AS DOUBLE)) * 1000 END AS c_sat
  FROM physical)"""


def physical(spark, sf_dir):
    grid = denormalize_grid(prepared(spark, sf_dir), FEATURES, RANGES)
    return grid.select(
        "experiment_id",
        "idx",
        substance_of(F.col("experiment_id")).alias("substance"),
        names.col("ftir:concentration").alias("c"),
        names.col("ftir:temperature").alias("t"),
    )


@query("saturation", f"{SATURATED} SELECT experiment_id, idx, round(c_sat, 6) AS saturation FROM saturated")
def saturation(spark, sf_dir):
    found = physics.saturation(F.col("t"), F.col("substance"))
    return physical(spark, sf_dir).select("experiment_id", "idx", F.round(found, 6).alias("saturation"))


@query("supersaturation", f"{SATURATED} SELECT experiment_id, idx, round(c / c_sat, 8) AS ratio FROM saturated")
def supersaturation(spark, sf_dir):
    found = physics.supersaturation(F.col("c"), F.col("t"), F.col("substance"))
    return physical(spark, sf_dir).select("experiment_id", "idx", F.round(found, 8).alias("ratio"))


@query("fe_supersaturation", f"{SATURATED} SELECT experiment_id, idx, round(c / c_sat / 5, 8) AS value FROM saturated")
def fe_supersaturation(spark, sf_dir):
    found = feature_ops.supersaturation_feature(
        prepared(spark, sf_dir), RANGES, substance_of(F.col("experiment_id")), normalize=True
    )
    return found.select("experiment_id", "idx", F.round(names.col("fe:supersaturation"), 8).alias("value"))


@query(
    "fixed_feature",
    f"WITH {prepared_sql()} SELECT experiment_id, idx, CAST(200.5 AS DOUBLE) AS stirrer FROM prep WHERE feature = 'sensor:intensity'",
)
def fixed_feature(spark, sf_dir):
    found = feature_ops.fixed_feature(prepared(spark, sf_dir), "fix:stirrer=200.5")
    return found.select("experiment_id", "idx", names.col("fix:stirrer=200.5").alias("stirrer"))
