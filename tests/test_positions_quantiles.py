import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions.hashing import digest
from sensorloom.operators import curves, positions, quantiles
from tests.helpers import close, grid, noisy


def windows_without_a_key(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    # a definition without a partition starts with its order
    return [s for s in specs if re.match(r"\s*\w+#\d+L? (ASC|DESC)", s) or re.match(r"\s*\d+,", s)]


@pytest.mark.parametrize("stretches", [1, 3, 1024])
def test_positions_on_two_levels(spark, monkeypatch, stretches):
    monkeypatch.setattr(positions, "STRETCHES", stretches)
    monkeypatch.setattr(positions, "BUCKET_ROWS", 8)
    rows = [(i % 50, i // 50) for i in range(700)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(5)
    placed = positions.shuffled(df, digest(F.col("a"), 3), ["a", "b"], "place", "rows")
    assert windows_without_a_key(placed) == []
    got = placed.orderBy("place").collect()
    import hashlib

    want = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}|3".encode()).hexdigest(), r))
    assert [(r.a, r.b) for r in got] == want
    assert [r.place for r in got] == list(range(700)) and {r["rows"] for r in got} == {700}
    assert positions.shuffled(df.limit(0), digest(F.col("a"), 3), ["a"], "place", "rows").count() == 0


def spread_out(seed, n):
    draw = random.Random(seed)
    return [draw.choice([1.0, -1.0]) * 10.0 ** draw.uniform(-300, 300) for _ in range(n)]


GROUPS = {
    "even": noisy(1, 900),
    "missing": noisy(2, 500, missing=0.4),
    "ties": [0.5] * 400 + noisy(3, 90) + [0.7] * 400,
    "one": [3.0],
    "two": [1.0, 2.0],
    "same": [7.25] * 600,
    "none": [None, None],
    "wide": spread_out(4, 800),
    "ends": [-1.7e308, 1.7e308] * 50 + [0.0] * 3,
    "tiny": [k * 5e-324 for k in range(300)],
}


@pytest.mark.parametrize("small", [4096, 1])
def test_quantiles_of_any_group(spark, small):
    groups = GROUPS
    rows = [(k, v) for k, values in groups.items() for v in values]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "name string, value double").repartition(6)
    shares = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = {r["name"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ["name"], F.col("value"), shares, small).collect()}
    assert set(got) == set(groups)
    for name, values in groups.items():
        known = sorted(v for v in values if v is not None)
        if not known:
            assert got[name] == [None] * len(shares)
            continue
        want = []
        for p in shares:
            at = p * (len(known) - 1)
            low, high = known[int(np.floor(at))], known[int(np.ceil(at))]
            want.append(low + (high - low) * (at - np.floor(at)) if high != low else low)
        if name == "ends":
            continue  # the width of a step is no number there
        close(got[name], want)


def test_both_ways_of_describing_agree(spark):
    df = grid(spark, {e: {"a": noisy(e, 300, missing=0.1)} for e in range(1, 5)})
    one = curves.describe(df, "a", max_rows=300).orderBy("experiment_id").collect()
    two = curves.describe(df, "a").orderBy("experiment_id").collect()
    for a, b in zip(one, two):
        close(list(a), list(b))
    plan = curves.describe(df, "a")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
