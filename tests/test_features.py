import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sensorloom.functions import names, physics
from sensorloom.operators import features
from tests.helpers import START, column, grid, mean

X, T = "sensor:intensity", "sensor:temperature"


def nucleation(values, minutes):
    """The rule applied row by row."""
    n = len(values)
    diff = [0.0] + [values[i] - values[i - 1] for i in range(1, n)]
    width, near = n // 10, n // 50
    rate = [mean(diff[max(0, i - width // 2) : i + (width - 1) // 2 + 1]) for i in range(n)]
    best = None
    for i in range(near + 1, n - near):
        if near < 1 or minutes(i) < 10 or rate[i] <= 0:
            continue
        before, after = mean(rate[i - near : i]), mean(rate[i : i + near])
        if before + 1e-11 < rate[i] < after - 1e-11 and (best is None or rate[i] > rate[best] + 1e-11):
            best = i
    return best


def signal(seed, n):
    draw = random.Random(seed)
    level, out = 0.0, []
    for i in range(n):
        level += draw.uniform(-0.02, 0.02) + (0.05 if n // 3 < i < n // 2 else 0)
        out.append(level)
    return out


@pytest.mark.parametrize("mode", ["minute_of_hour", "elapsed"])
@pytest.mark.parametrize("blocks", [{"max_rows": 1000}, {"block_rows": 37}])
def test_nucleation_point(spark, mode, blocks):
    lengths = {1: 60, 2: 151, 3: 230, 4: 49, 5: 400}
    series = {e: signal(e, n) for e, n in lengths.items()}
    df = grid(spark, {e: {X: v, T: v} for e, v in series.items()})
    marked = features.nucleation_candidates(df, mode=mode, **blocks)
    found = {r.experiment_id: r.idx for r in features.nucleation_point(marked).collect()}
    for e, v in series.items():
        def minutes(i):
            return (START + timedelta(seconds=60 * i)).minute if mode == "minute_of_hour" else i
        assert found.get(e) == nucleation(v, minutes), e


@pytest.mark.parametrize("blocks", [{"max_rows": 1000}, {"block_rows": 37}])
def test_nucleation_temperature_is_constant(spark, blocks):
    v = signal(2, 151)
    df = grid(spark, {2: {X: v, T: list(range(151))}, 9: {X: [0.0] * 60, T: [1.0] * 60}})
    got = features.nucleation_temperature(df, "elapsed", **blocks)
    at = nucleation(v, lambda i: i)
    assert column(got, "fe:nucleation_temperature", 2) == [float(at)] * 151
    assert column(got, "fe:nucleation_temperature", 9) == [None] * 60


def test_required_features_add_all_dependencies():
    got = features.required_features(("fe:supersaturation", "fe:nucleation_temperature"), ("a:b",), ("a:b", "fix:k=1.5"))
    assert got == [
        "fe:supersaturation", "fe:nucleation_temperature", "a:b", "fix:k=1.5",
        "ftir:concentration", "ftir:temperature", "sensor:intensity", "sensor:temperature",
    ]
    with pytest.raises(ValueError):
        features.required_features(("fe:unknown",))
    with pytest.raises(ValueError):
        features.required_features(("no feature",))


def test_supersaturation(spark):
    row = spark.range(1).select(
        physics.supersaturation(F.lit(50.0), F.lit(20.0), F.lit("adipin")).alias("acid"),
        physics.saturation(F.lit(20.0), F.lit("kh2po4")).alias("phosphate"),
        physics.saturation(F.lit(20.0), F.lit("salt")).alias("unknown"),
    ).first()
    assert math.isclose(row.acid, 50 / (13.505 * math.exp(0.0418 * 20)))
    assert math.isclose(row.phosphate, (4.6479e-5 * 293.15**2 - 0.022596 * 293.15 + 2.8535) * 1000)
    assert row.unknown is None


def test_kinetics_edges(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    k = F.lit(2.0)
    assert one(physics.nucleation_rate(F.lit(1.0), k, k)) == 0.0
    assert one(physics.nucleation_rate(F.lit(0.0), k, k)) is None
    assert one(physics.nucleation_rate(F.lit(-1.0), k, k)) is None
    assert math.isclose(one(physics.nucleation_rate(F.lit(2.0), k, k)), 4 * math.exp(-2 / math.log(2) ** 2))
    assert one(physics.growth_rate(F.lit(1.0), F.lit(2.0), k, F.lit(1.5))) is None
    assert one(physics.growth_rate_by_size(F.lit(1.0), F.lit(1.0), F.lit(2.0), k, F.lit(1.5))) == 0.0
    assert one(physics.suspended_mass(F.lit(60.0), F.lit("aa"))) == 0.0
    assert one(physics.suspended_mass(F.lit(300.0), F.lit("pdp"))) == 70.0


def test_fixed_values(spark):
    rows = spark.createDataFrame([("fix:a=1.5",), ("fix:a=x",), ("a:b",), ("fix:a=-2",)], "name string")
    assert [r[0] for r in rows.select(names.fixed_value(F.col("name"))).collect()] == [1.5, None, None, -2.0]
    df = features.fixed_feature(grid(spark, {1: {"a": [1, 2]}}), "fix:k=2.5")
    assert column(df, "fix:k=2.5") == [2.5, 2.5]


def test_nucleation_sorts_an_experiment_once(spark):
    df = grid(spark, {e: {"sensor:intensity": [float(i % 7) for i in range(120)]} for e in (1, 2)})
    whole, blocks = (features.nucleation_candidates(df, **o) for o in ({"max_rows": 120}, {"block_rows": 16}))
    rows = [sorted((r.experiment_id, r.idx, r.rate, r.candidate) for r in found.collect()) for found in (whole, blocks)]
    assert rows[0] == rows[1] and len(rows[0]) == 240
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 2


def test_sums_of_blocks_are_grouped_after_the_exchange(spark):
    """A row's few ends are not grouped before they meet, and tasks are not merged to fewer, larger ones."""
    data = grid(spark, {e: {X: signal(e, 200)} for e in (1, 2, 3)})
    blocked = features.nucleation_candidates(data, mode="elapsed", block_rows=16)
    plan = blocked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2
    whole = features.nucleation_candidates(data, mode="elapsed", max_rows=200)
    columns = ("experiment_id", "idx", "rate", "candidate")
    near = lambda df: sorted((r[0], r[1], None if r[2] is None else round(r[2], 9), r[3]) for r in df.select(*columns).collect())
    assert near(blocked) == near(whole) and any(r[3] for r in near(whole))
