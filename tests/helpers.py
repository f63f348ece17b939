"""Small frames and plain Python recomputations."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta, timezone

START = datetime(2024, 3, 5, 3, 0, 7, tzinfo=timezone.utc)


def readings(spark, rows):
    """rows of (experiment_id, feature, seconds after START, value)"""
    data = [(e, f, START + timedelta(seconds=s), v) for e, f, s, v in rows]
    return spark.createDataFrame(data, "experiment_id bigint, feature string, ts timestamp, value double")


def raw_readings(spark, rows, substance="aa"):
    data = []
    for e, f, s, v in rows:
        device, channel = f.split(":")
        data.append((e, substance, device, channel, START + timedelta(seconds=s), v))
    return spark.createDataFrame(
        data, "experiment_id bigint, substance string, device string, channel string, ts timestamp, value double"
    )


def grid(spark, series, step_seconds=60):
    """series: {experiment: {column: [values]}}"""
    columns = list(next(iter(series.values())))
    rows = []
    for experiment, values in series.items():
        n = len(values[columns[0]])
        for i in range(n):
            rows.append(
                (experiment, i, START + timedelta(seconds=step_seconds * i), n, *[_float(values[c][i]) for c in columns])
            )
    schema = "experiment_id bigint, idx bigint, ts timestamp, n_points bigint, " + ", ".join(f"`{c}` double" for c in columns)
    return spark.createDataFrame(rows, schema)


def column(df, name, experiment=None):
    rows = df.where(f"experiment_id = {experiment}") if experiment is not None else df
    return [r[name] for r in rows.orderBy("experiment_id", "idx").select("experiment_id", "idx", f"`{name}`").collect()]


def close(got, want, tolerance=1e-9):
    assert len(got) == len(want), (len(got), len(want))
    for i, (a, b) in enumerate(zip(got, want)):
        if a is None or b is None:
            assert a is None and b is None, (i, a, b)
        else:
            assert math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance), (i, a, b)


def noisy(seed, n, missing=0.0):
    draw = random.Random(seed)
    return [None if draw.random() < missing else draw.uniform(0, 1) for _ in range(n)]


def mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def _float(value):
    return None if value is None else float(value)
