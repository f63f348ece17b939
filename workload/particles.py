"""Queries over count bins, size distributions and kinetics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sensorloom.functions import names, physics
from sensorloom.operators import particles as ops
from sensorloom.plans.preparation import denormalize_grid, preprocess
from sensorloom.settings import DatasetSpec
from sensorloom.sources.readings import scan_features
from workload.adapters import BIN_FEATURES, BIN_RANGES, BINS, GRID, SMOOTHING, prepared_sql, readings, substance_of, table, wide_sql
from workload.process import SATURATED, physical
from workload.registry import query

SPEC = DatasetSpec(history=BIN_FEATURES, ranges=BIN_RANGES, substance=None, grid=GRID, smoothing=SMOOTHING)
STEP, L_MAX = 10.0, 300.0
SIZES = int(L_MAX / STEP)
WIDTH = L_MAX / (SIZES - 1)
SHORT = ("c10", "c50", "c150", "c300")
LIMITS = ((0, 10), (10, 50), (50, 150), (150, 300))
CENTRES = tuple((lo + hi) / 2 for lo, hi in LIMITS)


def counts(spark, sf_dir):
    points = scan_features(readings(spark, sf_dir, BINS), list(BIN_FEATURES))
    return denormalize_grid(preprocess(points, SPEC), BIN_FEATURES, BIN_RANGES)


def distribution(spark, sf_dir, form=ops.csd_from_bins):
    grid = counts(spark, sf_dir)
    mass = reduce(lambda a, b: a + b, [names.col(b) for b in BIN_FEATURES])
    return form(grid, BIN_FEATURES, mass, physics.density(substance_of(F.col("experiment_id"))), STEP, L_MAX)


COUNTS = f"""WITH {prepared_sql(profile=BINS, ranges=BIN_RANGES, features=BIN_FEATURES)},
raw AS (SELECT p.experiment_id, p.idx, p.us, p.n_points, p.feature, p.value * (hi - lo) + lo AS value FROM prep p JOIN ranges USING (feature)),
{wide_sql('raw', BIN_FEATURES)},
counts AS (SELECT experiment_id, idx, {", ".join(f'"{f}" AS {s}' for f, s in zip(BIN_FEATURES, SHORT))}, {" + ".join(f'"{f}"' for f in BIN_FEATURES)} AS total FROM wide)"""
MEAN = " + ".join(f"{s} / total * {c}" for s, c in zip(SHORT, CENTRES))
MIDDLE = f"(({MEAN}) / 4)"
MOMENTS = f"""{COUNTS}, moments0 AS (SELECT *, CASE WHEN total > 0 THEN {MEAN} END AS mean_size FROM counts),
moments AS (SELECT *, sqrt(({" + ".join(f"({s} / total * {c} - mean_size / 4) ** 2" for s, c in zip(SHORT, CENTRES))}) / 4) AS spread_ref,
  sqrt({" + ".join(f"{s} / total * ({c} - mean_size) ** 2" for s, c in zip(SHORT, CENTRES))}) AS weighted_std FROM moments0)"""
DENSITY = "CASE WHEN experiment_id % 2 = 0 THEN CAST(1.37 AS DOUBLE) ELSE CAST(2.34 AS DOUBLE) END"
CSD = f"""{MOMENTS},
sizes AS (SELECT n, n * CAST({WIDTH!r} AS DOUBLE) AS l FROM (SELECT unnest(range({SIZES})) AS n)),
pdf AS (SELECT experiment_id, idx, n, l, total, exp(CAST(-0.5 AS DOUBLE) * ((l - mean_size) / spread_ref) ** 2) / (spread_ref * sqrt(2 * pi())) AS p
  FROM (SELECT * REPLACE (CASE WHEN spread_ref > 0 THEN spread_ref END AS spread_ref) FROM moments), sizes),
share AS (SELECT *, p / nullif(sum(p) OVER (PARTITION BY experiment_id, idx), 0) AS f0 FROM pdf),
csd AS (SELECT experiment_id, CAST(idx AS DOUBLE) AS t, l,
  f0 * total / (sum(f0 * l * l * l * (pi() / 6 * CAST(1e-18 AS DOUBLE))) OVER (PARTITION BY experiment_id, idx) * {DENSITY}) AS f
  FROM share)"""


@query(
    "bin_limits",
    """WITH named AS (SELECT DISTINCT 'fbrm:counts_' || CASE user_id % 4 WHEN 0 THEN '10' WHEN 1 THEN '1000'
        WHEN 2 THEN (user_id % 50) || '-' || (user_id % 50 + 40) ELSE 'all' END AS name FROM events)
    SELECT name, CASE WHEN regexp_matches(name, '\\d+-\\d+$') THEN CAST(regexp_extract(name, '(\\d+)-(\\d+)$', 1) AS DOUBLE)
        WHEN name LIKE '%\\_1000' ESCAPE '\\' THEN 1000 ELSE 0 END AS lower_limit,
      CASE WHEN regexp_matches(name, '\\d+-\\d+$') THEN CAST(regexp_extract(name, '(\\d+)-(\\d+)$', 2) AS DOUBLE)
        WHEN name LIKE '%\\_10' ESCAPE '\\' THEN 10 WHEN name LIKE '%\\_1000' ESCAPE '\\' THEN 1001 ELSE 0 END AS upper_limit
    FROM named""",
)
def bin_limits(spark, sf_dir):
    user = F.col("experiment_id")
    low = (user % 50).cast("string")
    tail = (
        F.when(user % 4 == 0, F.lit("10"))
        .when(user % 4 == 1, F.lit("1000"))
        .when(user % 4 == 2, F.concat(low, F.lit("-"), (user % 50 + 40).cast("string")))
        .otherwise(F.lit("all"))
    )
    named = readings(spark, sf_dir).select(F.concat(F.lit("fbrm:counts_"), tail).alias("name")).distinct()
    lower, upper = names.bin_limits(F.col("name"))
    return named.select("name", lower.alias("lower_limit"), upper.alias("upper_limit"))


@query(
    "bin_percentages",
    f"""{COUNTS} SELECT experiment_id, idx, round(total, 6) AS total_count,
      {", ".join(f"round(CASE WHEN total <= 0 THEN 0 ELSE {s} / total END, 9) AS {s}" for s in SHORT)} FROM counts""",
)
def bin_percentages(spark, sf_dir):
    found = ops.bin_percentages(counts(spark, sf_dir), BIN_FEATURES)
    return found.select(
        "experiment_id",
        "idx",
        F.round("total_count", 6).alias("total_count"),
        *[F.round(names.col(b), 9).alias(s) for b, s in zip(BIN_FEATURES, SHORT)],
    )


@query(
    "bin_moments",
    f"{MOMENTS} SELECT experiment_id, idx, {', '.join(f'round({c}, 7) AS {c}' for c in ('mean_size', 'spread_ref', 'weighted_std'))} FROM moments",
)
def bin_moments(spark, sf_dir):
    found = ops.bin_moments(counts(spark, sf_dir), BIN_FEATURES)
    return found.select(
        "experiment_id", "idx", *[F.round(c, 7).alias(c) for c in ("mean_size", "spread_ref", "weighted_std")]
    )


@query(
    "csd_from_bins",
    f"""{CSD} SELECT experiment_id, t, round(l, 6) AS l, CASE WHEN f > 1e-200 THEN round(ln(f), 6) + 0.0 END AS log_f, f IS NULL AS missing FROM csd""",
)
def csd_from_bins(spark, sf_dir):
    """All sizes of all rows; logarithms of what is not next to nothing."""
    logarithm = F.when(F.col("f") > 1e-200, F.round(F.log("f"), 6))
    return distribution(spark, sf_dir).select(
        "experiment_id", "t", F.round("l", 6).alias("l"), logarithm.alias("log_f"), F.col("f").isNull().alias("missing")
    )


CSD_BINS = f"""{CSD} SELECT experiment_id, t, {", ".join(f"round(sum(CASE WHEN l >= {lo} AND l < {hi} THEN f ELSE 0 END) / sum(f), 8) AS {s}" for s, (lo, hi) in zip(SHORT, LIMITS))}
    FROM csd GROUP BY 1, 2"""


def _short(found):
    return found.select("experiment_id", "t", *[F.round(names.col(b), 8).alias(s) for b, s in zip(BIN_FEATURES, SHORT)])


@query("csd_to_bins", CSD_BINS)
def csd_to_bins(spark, sf_dir):
    return _short(ops.arrays_to_bins(distribution(spark, sf_dir, ops.csd_arrays), BIN_FEATURES, True, STEP, L_MAX))


@query("csd_rows_to_bins", CSD_BINS)
def csd_rows_to_bins(spark, sf_dir):
    """From a row for every size."""
    return _short(ops.csd_to_bins(distribution(spark, sf_dir), BIN_FEATURES))


CSD_MOMENTS = f"""{CSD}, sums AS (SELECT experiment_id, t, sum(f * 4 * pi() * (l / 2) * (l / 2) * CAST(1e-12 AS DOUBLE)) AS surface,
        sum(f * l * l * l * (pi() / 6 * CAST(1e-18 AS DOUBLE))) AS volume FROM csd GROUP BY 1, 2)
    SELECT experiment_id, t, round(ln(surface), 7) + 0.0 AS log_surface, round(volume, 7) AS volume, round(volume * {DENSITY}, 6) AS mass FROM sums"""


@query("csd_moments", CSD_MOMENTS)
def csd_moments(spark, sf_dir):
    density = physics.density(substance_of(F.col("experiment_id")))
    return _logged(ops.array_moments(distribution(spark, sf_dir, ops.csd_arrays), density, STEP, L_MAX))


@query("csd_row_moments", CSD_MOMENTS)
def csd_row_moments(spark, sf_dir):
    density = physics.density(substance_of(F.col("experiment_id")))
    return _logged(ops.csd_moments(distribution(spark, sf_dir), density))


def _logged(found):
    return found.select(
        "experiment_id",
        "t",
        F.round(F.log("surface"), 7).alias("log_surface"),
        F.round("volume", 7).alias("volume"),
        F.round("mass", 6).alias("mass"),
    )


@query(
    "size_index",
    f"""{MOMENTS} SELECT experiment_id, idx, CAST(round_even(mean_size / 0.5, 0) AS BIGINT) AS size_index,
      round_even(mean_size / 0.5, 0) * 0.5 AS size FROM moments""",
)
def size_index(spark, sf_dir):
    found = ops.bin_moments(counts(spark, sf_dir), BIN_FEATURES)
    index = ops.size_index(F.col("mean_size"), 0.5)
    return found.select("experiment_id", "idx", index.alias("size_index"), ops.index_size(index, 0.5).alias("size"))


RATIO = "(c / c_sat)"
EXCESS = "greatest((c - c_sat) / c_sat, 0)"


@query(
    "kinetics",
    f"""{SATURATED}
    SELECT experiment_id, idx, round(c_sat, 6) AS saturation, round({RATIO}, 8) AS supersaturation,
      round(CASE WHEN {RATIO} <= 0 THEN NULL WHEN {RATIO} = 1 THEN 0
        ELSE 2 * {RATIO} * exp(CAST(-0.1 AS DOUBLE) / (ln({RATIO}) * ln({RATIO}))) END, 7) + 0.0 AS nucleation_rate,
      CASE WHEN c >= c_sat THEN round(power(c - c_sat, 1.5), 5) END AS growth_rate,
      round(power({EXCESS}, 1.5) * (1 + CAST(0.1 AS DOUBLE) * 10), 7) AS growth_at_10,
      round(power({EXCESS}, 1.5) * (1 + CAST(0.1 AS DOUBLE) * 150), 7) AS growth_at_150,
      round(greatest((CASE WHEN substance = 'aa' THEN 50 ELSE 335 END - c) * 2, 0), 7) AS suspended_mass
    FROM (SELECT * FROM saturated WHERE c IS NOT NULL AND t IS NOT NULL)
    UNION ALL SELECT experiment_id, idx, round(c_sat, 6), NULL, NULL, NULL, NULL, NULL,
      CASE WHEN c IS NOT NULL THEN round(greatest((CASE WHEN substance = 'aa' THEN 50 ELSE 335 END - c) * 2, 0), 7) END
    FROM saturated WHERE c IS NULL OR t IS NULL""",
)
def kinetics(spark, sf_dir):
    found = ops.kinetics(
        physical(spark, sf_dir),
        F.col("c"),
        F.col("t"),
        F.col("substance"),
        nucleation=(2.0, 0.1),
        growth=(1.0, 1.5),
        sizes=(10.0, 150.0),
    )
    digits = {
        "saturation": 6, "supersaturation": 8, "nucleation_rate": 7, "growth_rate": 5,
        "growth_at_10": 7, "growth_at_150": 7, "suspended_mass": 7,
    }
    return found.select("experiment_id", "idx", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "substance_defaults",
    """SELECT DISTINCT event_type AS given, CASE event_type WHEN 'click' THEN 'pdp' WHEN 'view' THEN 'other' ELSE 'aa' END AS substance,
      CASE event_type WHEN 'click' THEN CAST(2.34 AS DOUBLE) WHEN 'view' THEN NULL ELSE CAST(1.37 AS DOUBLE) END AS density FROM events""",
)
def substance_defaults(spark, sf_dir):
    kind = F.col("event_type")
    named = F.when(kind == "click", "pdp").when(kind == "view", "other").when(kind == "error", "")
    rows = table(spark, sf_dir, "events").select(kind.alias("given"), named.alias("substance")).distinct()
    chosen = physics.substance_or_default(F.col("substance"))
    return rows.select("given", chosen.alias("substance"), physics.density(chosen).alias("density"))
