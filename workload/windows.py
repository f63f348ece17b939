"""Queries over windows, splits, batches and forecasts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sensorloom.functions import names
from sensorloom.operators import curves, epochs, forecast, gates, ordering
from sensorloom.operators import windows as window_ops
from sensorloom.plans import training
from sensorloom.plans.preparation import preprocess
from sensorloom.session import fresh_path, keep
from sensorloom.settings import WindowSpec
from sensorloom.sources import dataset as storage
from workload.adapters import FEATURES, GRID, SPEC, WINDOWS, long_form, prepared_sql, readings, wide_sql
from workload.process import prepared, process_readings
from workload.registry import query

H, P = WINDOWS.steps_history, WINDOWS.steps_prediction
LIMIT = GRID.max_rows
SEED = 42
SHARE = 0.2
BATCH = 32
RIDGE = 0.01


def cut(spark, sf_dir, block_rows=None):
    return window_ops.sliding_windows(prepared(spark, sf_dir), WINDOWS, LIMIT, block_rows)


def parts_long(windows):
    """History, label and controlled parts, one row per value."""

    def entries(part):
        def of_row(row, step):
            return F.transform(
                row,
                lambda value, column: F.struct(
                    F.lit(part).alias("part"),
                    step.cast("bigint").alias("step"),
                    column.cast("bigint").alias("column"),
                    value.cast("double").alias("value"),
                ),
            )

        return F.flatten(F.transform(part, of_row))

    every = F.concat(*[entries(part) for part in ("history", "label", "controlled")])
    return windows.select("experiment_id", "j", F.inline(every)).withColumn("value", F.round("value", 6))


STARTS = f"""{prepared_sql()},
lengths AS (SELECT experiment_id, max(idx) + 1 AS n FROM prep GROUP BY 1),
starts AS (SELECT DISTINCT p.experiment_id, p.idx AS j FROM prep p JOIN lengths USING (experiment_id)
           WHERE p.idx >= {H} AND p.idx < n - {P})"""


def _part(part, feature, column, first, last, starts="starts"):
    return f"""SELECT s.experiment_id, s.j, '{part}' AS part, p.idx - s.j - ({first}) AS step, CAST({column} AS BIGINT) AS "column",
      CAST(CAST(p.value AS FLOAT) AS DOUBLE) AS value
    FROM {starts} s JOIN prep p ON p.experiment_id = s.experiment_id AND p.feature = '{feature}'
      AND p.idx BETWEEN s.j + ({first}) AND s.j + ({last})"""


def parts_sql(starts="starts", parts=("history", "label", "controlled")):
    pieces = [_part("history", f, i, -H, -1, starts) for i, f in enumerate(WINDOWS.history)]
    pieces += [_part("label", f, i, 0, P - 1, starts) for i, f in enumerate(WINDOWS.prediction)]
    pieces += [_part("controlled", f, i, 0, P - 1, starts) for i, f in enumerate(WINDOWS.controlled) if "controlled" in parts]
    return " UNION ALL ".join(pieces)


PARTS = f"""WITH {STARTS}, parts AS ({parts_sql()})"""
SHOWN = 'SELECT experiment_id, j, part, step, "column", round(value, 6) + 0.0 AS value FROM'


@query("sliding_windows", f"{PARTS} {SHOWN} parts")
def sliding_windows(spark, sf_dir):
    return parts_long(cut(spark, sf_dir))


@query("sliding_windows_in_blocks", f"{PARTS} {SHOWN} parts")
def sliding_windows_in_blocks(spark, sf_dir):
    return parts_long(cut(spark, sf_dir, block_rows=16))


@query("sliding_windows_stored", f"{PARTS} {SHOWN} parts")
def sliding_windows_stored(spark, sf_dir):
    """From readings in buckets of experiments to windows: one scan and no exchange."""
    path = fresh_path(spark, "readings")
    stored = storage.store_by_experiment(process_readings(spark, sf_dir), path.rsplit("/", 1)[1].replace("-", "_"), "ts", path)
    return parts_long(window_ops.sliding_windows(preprocess(stored, SPEC), WINDOWS, LIMIT))


STRIDED = f"""WITH {STARTS},
strided AS (SELECT * FROM starts WHERE (j - {H}) % {2 * P} = 0),
found AS ({parts_sql('strided')}),
usable AS (SELECT experiment_id, j FROM found GROUP BY 1, 2
  HAVING bool_or(part = 'history' AND (value IS NULL OR value <> 0)) AND bool_or(part = 'controlled' AND (value IS NULL OR value <> 0)))"""


@query("predict_windows", f"{STRIDED} {SHOWN} found JOIN usable USING (experiment_id, j)")
def predict_windows(spark, sf_dir):
    return parts_long(window_ops.predict_windows(prepared(spark, sf_dir), WINDOWS, LIMIT))


UNCONTROLLED = replace(WINDOWS, controlled=())
OPEN = f"""WITH {STARTS},
strided AS (SELECT * FROM starts WHERE (j - {H}) % {2 * P} = 0),
found AS ({parts_sql('strided', ('history', 'label'))}),
usable AS (SELECT experiment_id, j FROM found GROUP BY 1, 2 HAVING bool_or(part = 'history' AND (value IS NULL OR value <> 0)))"""


@query("predict_windows_uncontrolled", f"{OPEN} {SHOWN} found JOIN usable USING (experiment_id, j)")
def predict_windows_uncontrolled(spark, sf_dir):
    return parts_long(window_ops.predict_windows(prepared(spark, sf_dir), UNCONTROLLED, LIMIT))


LONG_STEPS = 115


@query(
    "training_rejects",
    f"""WITH {prepared_sql()} SELECT experiment_id, 'train' AS stage, 'too short for a window' AS reason
    FROM prep GROUP BY 1 HAVING max(idx) + 1 <= {LONG_STEPS}""",
)
def training_rejects(spark, sf_dir):
    return gates.too_short_for_windows(prepared(spark, sf_dir), LONG_STEPS)


@query(
    "window_means",
    f"""{PARTS} SELECT experiment_id, j, round(avg(value) FILTER (WHERE "column" = 0), 6) AS intensity,
      round(avg(value) FILTER (WHERE "column" = 1), 6) AS temperature
    FROM parts WHERE part = 'history' GROUP BY 1, 2""",
)
def window_means(spark, sf_dir):
    means = window_ops.window_means(cut(spark, sf_dir), WINDOWS)
    return means.select(
        "experiment_id",
        "j",
        F.round(names.col("sensor:intensity"), 6).alias("intensity"),
        F.round(names.col("sensor:temperature"), 6).alias("temperature"),
    )


@query(
    "unwindow",
    f"""WITH {STARTS}, ends AS (SELECT experiment_id, max(j) AS last FROM starts GROUP BY 1),
    {wide_sql('prep', FEATURES)}
    SELECT experiment_id, idx,
      CASE WHEN idx < last THEN round(CAST(CAST("sensor:intensity" AS FLOAT) AS DOUBLE), 6) END AS intensity,
      CASE WHEN idx < last THEN round(CAST(CAST("sensor:temperature" AS FLOAT) AS DOUBLE), 6) END AS temperature,
      CASE WHEN idx >= {H} THEN round(CAST(CAST("ftir:temperature" AS FLOAT) AS DOUBLE), 6) END AS controlled
    FROM wide JOIN ends USING (experiment_id) WHERE idx < last + {P}""",
)
def unwindow(spark, sf_dir):
    return _unwound(cut(spark, sf_dir))


def _unwound(windows):
    found = window_ops.unwindow(windows, WINDOWS)
    rounded = {"h:sensor:intensity": "intensity", "h:sensor:temperature": "temperature", "c:ftir:temperature": "controlled"}
    return found.select(
        "experiment_id", "idx", *[F.round(names.col(c).cast("double"), 6).alias(n) for c, n in rounded.items()]
    )


@query(
    "unwindow_strided",
    f"""{STRIDED},
    {wide_sql('prep', FEATURES)},
    held AS (SELECT w.experiment_id, w.idx, bool_or(w.idx < u.j) AS history, bool_or(w.idx >= u.j) AS controlled
      FROM wide w JOIN usable u ON u.experiment_id = w.experiment_id AND w.idx BETWEEN u.j - {H} AND u.j + {P} - 1 GROUP BY 1, 2)
    SELECT experiment_id, idx,
      CASE WHEN history THEN round(CAST(CAST("sensor:intensity" AS FLOAT) AS DOUBLE), 6) END AS intensity,
      CASE WHEN history THEN round(CAST(CAST("sensor:temperature" AS FLOAT) AS DOUBLE), 6) END AS temperature,
      CASE WHEN controlled THEN round(CAST(CAST("ftir:temperature" AS FLOAT) AS DOUBLE), 6) END AS controlled
    FROM wide JOIN held USING (experiment_id, idx)""",
)
def unwindow_strided(spark, sf_dir):
    """From windows that leave rows out between them and lack those without values."""
    return _unwound(window_ops.predict_windows(prepared(spark, sf_dir), WINDOWS, LIMIT))


# --- splits and batches -----------------------------------------------------------

SPLIT = f"""ids AS (SELECT DISTINCT user_id AS experiment_id FROM events),
placed AS (SELECT experiment_id, row_number() OVER (ORDER BY md5(experiment_id || '|{SEED}'), experiment_id) - 1 AS position,
                  count(*) OVER () AS total FROM ids),
split AS (SELECT experiment_id, position,
  CASE WHEN position < ceil(total * CAST({1 - SHARE} AS DOUBLE)) THEN 'train' ELSE 'validation' END AS split FROM placed)"""


@query("group_split", f"WITH {SPLIT} SELECT * FROM split")
def group_split(spark, sf_dir):
    return ordering.group_split(readings(spark, sf_dir), SHARE, SEED)


@query(
    "split_windows",
    f"WITH {STARTS}, {SPLIT} SELECT split, experiment_id, count(*) AS windows FROM starts JOIN split USING (experiment_id) GROUP BY 1, 2",
)
def split_windows(spark, sf_dir):
    split = ordering.group_split(readings(spark, sf_dir), SHARE, SEED)
    placed = ordering.split_windows(cut(spark, sf_dir), split)
    return placed.groupBy("split", "experiment_id").agg(F.count("*").alias("windows"))


@query(
    "batches",
    f"""WITH {STARTS},
    placed AS (SELECT experiment_id, j, row_number() OVER (ORDER BY md5(experiment_id || '|' || j || '|{SEED}|3'), experiment_id, j) - 1 AS position,
               count(*) OVER () AS total FROM starts)
    SELECT experiment_id, j, position // {BATCH} AS batch_id, position % {BATCH} AS place
    FROM placed WHERE position // {BATCH} < total // {BATCH}""",
)
def batches(spark, sf_dir):
    grid = keep(prepared(spark, sf_dir), "grid")
    found = ordering.batched_windows(grid, WINDOWS, BATCH, SEED, epoch=3, max_rows=LIMIT)
    return found.select("experiment_id", "j", "batch_id", "place")


# --- forecasts --------------------------------------------------------------------

CARRIED = f"""{PARTS},
carried AS (
  SELECT l.experiment_id, l.j, l.step, l.value AS label, h.value AS prediction
  FROM parts l JOIN parts h ON h.experiment_id = l.experiment_id AND h.j = l.j
  WHERE l.part = 'label' AND h.part = 'history' AND h.step = {H - 1} AND h."column" = 0)"""


@query(
    "forecast_metrics",
    f"""{CARRIED.replace('WITH', 'WITH ' + SPLIT + ',', 1)}
    SELECT split, count(label - prediction) AS "values", round(avg((label - prediction) * (label - prediction)), 9) AS mse,
           round(avg(abs(label - prediction)), 9) AS mae
    FROM carried JOIN split USING (experiment_id) GROUP BY 1""",
)
def forecast_metrics(spark, sf_dir):
    """Errors of carrying the last value on."""
    placed = training.training_windows(prepared(spark, sf_dir), WINDOWS, SHARE, SEED, LIMIT)
    found = forecast.forecast_metrics(forecast.persistence(placed, WINDOWS), ["split"])
    return found.select("split", "values", F.round("mse", 9).alias("mse"), F.round("mae", 9).alias("mae"))


TIMELINE = f"""{STRIDED},
carried AS (SELECT u.experiment_id, u.j, f.value AS prediction FROM usable u JOIN found f
  ON f.experiment_id = u.experiment_id AND f.j = u.j AND f.part = 'history' AND f.step = {H - 1} AND f."column" = 0),
placed AS (SELECT experiment_id, unnest(range(j, j + {P})) AS idx, prediction FROM carried),
{wide_sql('prep', FEATURES)}"""


@query(
    "prediction_timeline",
    f"""{TIMELINE} SELECT experiment_id, idx, round(prediction, 6) AS predicted FROM wide LEFT JOIN placed USING (experiment_id, idx)""",
)
def prediction_timeline(spark, sf_dir):
    grid = prepared(spark, sf_dir)
    predictions = forecast.persistence(window_ops.predict_windows(grid, WINDOWS, LIMIT), WINDOWS)
    found = window_ops.prediction_timeline(grid, predictions, WINDOWS.prediction)
    return found.select(
        "experiment_id", "idx", F.round(names.col("sensor:intensity_PREDICTED").cast("double"), 6).alias("predicted")
    )


@query(
    "prediction_report",
    f"""{TIMELINE} SELECT experiment_id, idx, round("sensor:intensity", 9) AS intensity, round("sensor:temperature", 9) AS temperature,
      round("ftir:temperature", 9) AS controlled, round(prediction, 6) AS predicted
    FROM wide LEFT JOIN placed USING (experiment_id, idx)""",
)
def prediction_report(spark, sf_dir):
    grid = prepared(spark, sf_dir)
    predictions = forecast.persistence(window_ops.predict_windows(grid, WINDOWS, LIMIT), WINDOWS)
    found = forecast.prediction_report(grid, predictions, WINDOWS)
    return found.select(
        "experiment_id",
        "idx",
        F.round(names.col("sensor:intensity"), 9).alias("intensity"),
        F.round(names.col("sensor:temperature"), 9).alias("temperature"),
        F.round(names.col("ftir:temperature"), 9).alias("controlled"),
        F.round(names.col("sensor:intensity_PREDICTED").cast("double"), 6).alias("predicted"),
    )


CONSTANT = H * len(WINDOWS.history) + P * len(WINDOWS.controlled)
ENTRIES = f"""{PARTS},
    bad AS (SELECT DISTINCT experiment_id, j FROM parts WHERE value IS NULL),
    entries AS (
      SELECT experiment_id, j, CASE part WHEN 'history' THEN step * {len(WINDOWS.history)} + "column"
          WHEN 'controlled' THEN {H * len(WINDOWS.history)} + step * {len(WINDOWS.controlled)} + "column"
          ELSE {CONSTANT + 1} + step * {len(WINDOWS.prediction)} + "column" END AS position, value
      FROM parts ANTI JOIN bad USING (experiment_id, j)
      UNION ALL SELECT experiment_id, j, {CONSTANT}, 1.0 FROM starts ANTI JOIN bad USING (experiment_id, j))"""


@query(
    "forecast_sums",
    f"""{ENTRIES}
    SELECT a.position AS "row", b.position AS "col", round(sum(a.value * b.value), 6) AS value
    FROM entries a JOIN entries b ON b.experiment_id = a.experiment_id AND b.j = a.j AND a.position <= b.position GROUP BY 1, 2""",
)
def forecast_sums(spark, sf_dir):
    """The matrix of summed products a fit is solved from."""
    found = forecast.gramian(cut(spark, sf_dir), WINDOWS)
    return found.select(
        F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.round("value", 6).alias("value")
    )


@query("forecast_fit")
def forecast_fit(spark, sf_dir):
    model = training.train(prepared(spark, sf_dir), WINDOWS, RIDGE, SHARE, SEED, LIMIT).model
    return forecast.coefficients(spark, model)


@query("forecast_errors")
def forecast_errors(spark, sf_dir):
    return training.train(prepared(spark, sf_dir), WINDOWS, RIDGE, SHARE, SEED, LIMIT).metrics


@query("forecast_predict")
def forecast_predict(spark, sf_dir):
    grid = prepared(spark, sf_dir)
    model = training.train(grid, WINDOWS, RIDGE, SHARE, SEED, LIMIT).model
    predictions = forecast.predict(window_ops.predict_windows(grid, WINDOWS, LIMIT), model)
    return forecast.prediction_report(grid, predictions, WINDOWS)


@query("param_sweep")
def param_sweep(spark, sf_dir):
    trials = training.grid_suggestions(nr_timesteps_history=[3, 6], ridge=[0.0, 0.001, 0.01, 0.1])
    return training.param_sweep(prepared(spark, sf_dir), WINDOWS, trials, SHARE, SEED, LIMIT)


@query(
    "center_trim",
    f"""WITH {prepared_sql()},
    lengths AS (SELECT experiment_id, max(idx) + 1 AS n FROM prep GROUP BY 1),
    starts AS (SELECT experiment_id, (n - (SELECT min(n) FROM lengths)) // 2 AS s, (SELECT min(n) FROM lengths) AS shortest FROM lengths)
    SELECT experiment_id, idx - s AS idx, feature, round(value, 9) AS value FROM prep JOIN starts USING (experiment_id)
    WHERE idx >= s AND idx < s + shortest""",
)
def center_trim(spark, sf_dir):
    return long_form(curves.center_trim(prepared(spark, sf_dir)), FEATURES)


# --- a forecast whose fit has a closed form ---------------------------------------

ONE_STEP = WindowSpec(("sensor:intensity",), ("sensor:intensity",), (), 1, 1)
FITTED = f"""WITH {prepared_sql()},
signal AS (SELECT experiment_id, idx, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v, max(idx) OVER (PARTITION BY experiment_id) + 1 AS n
  FROM prep WHERE feature = 'sensor:intensity'),
pairs AS (SELECT b.experiment_id, b.idx AS j, a.v AS x, b.v AS y FROM signal a JOIN signal b ON a.experiment_id = b.experiment_id AND a.idx = b.idx - 1
  WHERE b.idx < b.n - 1),
line AS (SELECT covar_pop(y, x) / (var_pop(x) + {RIDGE}) AS slope, avg(y) AS y, avg(x) AS x FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL)"""


def _one_step(spark, sf_dir):
    return window_ops.sliding_windows(prepared(spark, sf_dir), ONE_STEP, LIMIT)


@query(
    "forecast_fit_one_step",
    f"""{FITTED} SELECT 0 AS input, 0 AS output, round(slope, 6) AS weight FROM line
    UNION ALL SELECT 1, 0, round(y - slope * x, 6) FROM line""",
)
def forecast_fit_one_step(spark, sf_dir):
    """One past value predicts the next one: the ridge fit is a covariance over a variance."""
    model = forecast.fit(window_ops.complete(_one_step(spark, sf_dir)), ONE_STEP, RIDGE)
    return forecast.coefficients(spark, model).withColumn("weight", F.round("weight", 6))


@query("forecast_predict_one_step", f"{FITTED} SELECT experiment_id, j, round(CAST(CAST(line.y + slope * (pairs.x - line.x) AS FLOAT) AS DOUBLE), 5) + 0.0 AS predicted FROM pairs, line")
def forecast_predict_one_step(spark, sf_dir):
    windows = _one_step(spark, sf_dir)
    found = forecast.predict(windows, forecast.fit(window_ops.complete(windows), ONE_STEP, RIDGE))
    value = F.get(F.get("prediction", F.lit(0)), F.lit(0)).cast("double")
    return found.select("experiment_id", "j", F.round(value, 5).alias("predicted"))


RIDGES = (0.0, 0.001, 0.01, 0.1)


@query(
    "param_sweep_one_step",
    f"""{FITTED.replace('WITH', 'WITH ' + SPLIT + ',', 1)},
    known AS (SELECT split, x, y FROM pairs JOIN split USING (experiment_id) WHERE x IS NOT NULL AND y IS NOT NULL),
    trials(trial, ridge) AS (VALUES {", ".join(f"({k}, CAST({r} AS DOUBLE))" for k, r in enumerate(RIDGES))}),
    fits AS (SELECT trial, ridge, any_value(slope) AS slope, any_value(ym - slope * xm) AS shift FROM (SELECT trial, ridge, ym, xm, cxy / (vx + ridge) AS slope
      FROM trials, (SELECT covar_pop(y, x) AS cxy, var_pop(x) AS vx, avg(y) AS ym, avg(x) AS xm FROM known WHERE split = 'train')) GROUP BY 1, 2),
    losses AS (SELECT trial, ridge, avg((y - slope * x - shift) ** 2) FILTER (WHERE split = 'train') AS loss,
      avg((y - slope * x - shift) ** 2) FILTER (WHERE split = 'validation') AS val_loss FROM fits, known GROUP BY 1, 2)
    SELECT trial, 1 AS steps_history, 1 AS steps_prediction, ridge, round(loss, 8) AS loss, round(val_loss, 8) AS val_loss,
      round(coalesce(val_loss, loss), 8) AS objective FROM losses""",
)
def param_sweep_one_step(spark, sf_dir):
    """A sweep over penalties whose fits and errors have a closed form."""
    found = training.param_sweep(prepared(spark, sf_dir), ONE_STEP, training.grid_suggestions(ridge=list(RIDGES)), SHARE, SEED, LIMIT)
    return found.withColumns({c: F.round(c, 8) for c in ("loss", "val_loss", "objective")})


# --- training by epochs -----------------------------------------------------------

RATE, MOMENTUM, EPOCHS, STEPS = 0.25, 0.5, 3, 4


@query(
    "train_step",
    f"""{ENTRIES.replace('WITH', 'WITH ' + SPLIT + ',', 1)},
    learned AS (SELECT e.* FROM entries e JOIN split USING (experiment_id) WHERE split = 'train')
    SELECT a.position AS input, b.position - {CONSTANT + 1} AS output, round({RATE} * 2 * sum(a.value * b.value)
      / ((SELECT count(*) FROM learned WHERE position = {CONSTANT}) * {P * len(WINDOWS.prediction)}), 6) AS weight
    FROM learned a JOIN learned b USING (experiment_id, j) WHERE a.position <= {CONSTANT} AND b.position > {CONSTANT} GROUP BY 1, 2""",
)
def train_step(spark, sf_dir):
    """The weights after one step of descent from zero over all training windows."""
    descent = epochs.Descent(RATE)
    trained = training.train_epochs(prepared(spark, sf_dir), WINDOWS, 1, optimizer=descent, validation_share=SHARE, seed=SEED, max_rows=LIMIT)
    return forecast.coefficients(spark, trained.model).select(
        F.col("input").cast("bigint").alias("input"), F.col("output").cast("bigint").alias("output"), F.round("weight", 6).alias("weight")
    )


EPOCH_LOG = f"""WITH RECURSIVE {prepared_sql()}, {SPLIT},
signal AS (SELECT experiment_id, idx, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v, max(idx) OVER (PARTITION BY experiment_id) + 1 AS n
  FROM prep WHERE feature = 'sensor:intensity'),
pairs AS (SELECT b.experiment_id, b.idx AS j, a.v AS x, b.v AS y FROM signal a JOIN signal b ON a.experiment_id = b.experiment_id AND a.idx = b.idx - 1
  WHERE b.idx < b.n - 1 AND a.v IS NOT NULL AND b.v IS NOT NULL),
sums AS MATERIALIZED (SELECT split, ('0x' || substr(md5(experiment_id || '|' || j || '|{SEED}'), 1, 8))::BIGINT % {epochs.SHARDS} AS shard, count(*) AS n,
  sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM pairs JOIN split USING (experiment_id) GROUP BY ALL),
dealt AS (SELECT epoch, shard, epoch * {STEPS} + (row_number() OVER (PARTITION BY epoch ORDER BY md5(shard || '|{SEED}|' || epoch), shard) - 1)
  * {STEPS} // {epochs.SHARDS} AS t FROM range({EPOCHS}) e(epoch), range({epochs.SHARDS}) s(shard)),
batch AS MATERIALIZED (SELECT t, any_value(epoch) AS epoch, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy
  FROM dealt JOIN sums USING (shard) WHERE split = 'train' GROUP BY t),
run AS (SELECT 0::BIGINT AS t, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS va, 0::DOUBLE AS vb
  UNION ALL SELECT t + 1, a + wa, b + wb, wa, wb FROM (SELECT t, a, b,
    {MOMENTUM} * va - {RATE} * (2 * (a * sxx + b * sx - sxy) / n + 2 * {RIDGE} * a) AS wa, {MOMENTUM} * vb - {RATE} * 2 * (a * sx + b * n - sy) / n AS wb
    FROM run JOIN batch USING (t))),
steps AS (SELECT epoch, (a * a * sxx + 2 * a * b * sx + b * b * n - 2 * a * sxy - 2 * b * sy + syy) / n AS loss FROM run JOIN batch USING (t)),
held AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM sums WHERE split = 'validation'),
ends AS (SELECT t // {STEPS} AS epoch, (a * a * sxx + 2 * a * b * sx + b * b * n - 2 * a * sxy - 2 * b * sy + syy) / n AS val_loss
  FROM run, held WHERE t > 0 AND t % {STEPS} = 0),
log AS (SELECT ends.epoch::INTEGER AS epoch, round(avg(loss), 6) AS loss, round(any_value(val_loss), 6) AS val_loss
  FROM ends JOIN steps ON steps.epoch = ends.epoch - 1 GROUP BY ends.epoch)"""


def epoch_training(spark, sf_dir):
    """A line from one value to the next, fitted in three epochs of four steps each."""
    return training.train_epochs(
        prepared(spark, sf_dir), ONE_STEP, EPOCHS, STEPS, "mse", epochs.Descent(RATE, MOMENTUM), RIDGE, None, SHARE, SEED, LIMIT
    )


@query("train_epochs", f"{EPOCH_LOG} SELECT * FROM log")
def train_epochs(spark, sf_dir):
    return epoch_training(spark, sf_dir).log.select("epoch", F.round("loss", 6).alias("loss"), F.round("val_loss", 6).alias("val_loss"))
