import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import gates, series, windows
from sensorloom.plans import dataset as job
from sensorloom.plans.preparation import preprocess
from sensorloom.settings import DatasetSpec, Grid, WindowSpec
from sensorloom.sources import dataset as storage
from tests.helpers import column, grid, noisy, raw_readings, readings

X, T = "sensor:intensity", "sensor:temperature"
SPEC = DatasetSpec((X, T), (X,), (), ranges={X: (0, 300), T: (5, 75)}, grid=Grid(6), smoothing=5)


def experiment(e, seconds=1200, step=5, shift=0.0):
    rows = []
    for s in range(0, seconds + 1, step):
        rows.append((e, X, s, 50 + 40 * math.sin(s / 300 + shift) + e))
        rows.append((e, T, s, 30 + 10 * math.cos(s / 200 + shift)))
    return rows


def table(spark):
    rows = [r for e in range(1, 7) for r in experiment(e, shift=e)]
    rows += [r for r in experiment(10) if r[1] == X]  # no temperature
    rows += experiment(11, seconds=30)  # too short
    rows += experiment(12, seconds=180_000, step=600)  # too long
    rows += [*experiment(13), (13, X, 5, 1.0)]  # duplicate time
    return raw_readings(spark, rows)


def test_rejects_and_grid(spark):
    wanted = spark.createDataFrame([(i,) for i in [*range(1, 7), 10, 11, 12, 13, 99]], "experiment_id bigint")
    found = job.generate_dataset(table(spark), SPEC, wanted)
    assert found.action == "keep"
    assert {r.experiment_id: (r.stage, r.reason) for r in found.rejects.collect()} == {
        10: ("scan", f"no data for {T}"),
        11: ("preprocess", "too short"),
        12: ("preprocess", "too long"),
        13: ("scan", "duplicate timestamp"),
        99: ("scan", "no data"),
    }
    counts = {r.experiment_id: r["count"] for r in found.grid.groupBy("experiment_id").count().collect()}
    assert counts == {e: 120 for e in range(1, 7)}


@pytest.mark.parametrize("dps", [6, 7])
def test_job_equals_plain_preparation(spark, dps):
    spec = replace(SPEC, grid=Grid(dps))
    rows = [r for e in (1, 2) for r in experiment(e)]
    whole = job.generate_dataset(raw_readings(spark, rows), spec).grid
    plain = preprocess(readings(spark, rows), spec)
    for name in (X, T, "idx", "ts"):
        assert column(whole, name) == column(plain, name)
    assert column(whole, "idx", 1) == list(range(20 * dps))


def test_without_resampling_rows_keep_their_times(spark):
    rows = experiment(1)
    got = preprocess(readings(spark, rows), replace(SPEC, resample=False, smooth=False))
    assert column(got, "idx") == list(range(241))
    want = [(v - 0) / 300 for _, f, _, v in rows if f == X]
    assert all(math.isclose(a, b) for a, b in zip(column(got, X), want))


def test_missing_range_rejects_everything(spark):
    found = job.generate_dataset(table(spark), replace(SPEC, ranges={X: (0, 300)}))
    assert found.grid.count() == 0
    assert {r.reason for r in found.rejects.where("experiment_id < 7").collect()} == {f"no range for {T}"}


def test_small_sets_grow(spark):
    found = job.generate_dataset(table(spark), replace(SPEC, min_experiments=9))
    ids = {r.experiment_id for r in found.grid.select("experiment_id").distinct().collect()}
    assert found.action == "augment" and ids == {*range(1, 7), 2000, 2001, 2002}


def test_large_sets_are_cut_to_representatives(spark, tmp_path):
    found = job.generate_dataset(table(spark), replace(SPEC, max_experiments=4, clusters=2))
    assert found.action == "cluster"
    ids = {r.experiment_id for r in found.grid.select("experiment_id").distinct().collect()}
    assert ids == {r.experiment_id for r in found.selection.members.collect()} and 2 <= len(ids) <= 4
    job.save(found, str(tmp_path))
    assert {r.experiment_id for r in storage.read_experiment_list(spark, f"{tmp_path}/experiments").collect()} == ids
    back = storage.read_dataset(spark, f"{tmp_path}/grid", found.grid.schema)
    assert back.count() == found.grid.count()
    assert spark.read.json(f"{tmp_path}/top_experiments").count() == len(ids)


def test_derived_features(spark):
    spec = replace(
        SPEC,
        history=(X, "fe:nucleation_temperature", "fix:stirrer=200"),
        nucleation_start="elapsed",
    )
    found = job.generate_dataset(table(spark), spec)
    assert "fix:stirrer=200" in found.grid.columns
    per = found.grid.groupBy("experiment_id").agg(F.count_distinct("`fe:nucleation_temperature`").alias("n")).collect()
    assert all(r.n == 1 for r in per)
    lost = {r.experiment_id for r in found.rejects.where("stage = 'features'").collect()}
    assert lost | {r.experiment_id for r in per} == set(range(1, 7))


def test_stored_sets_are_replaced_and_pruned(spark, tmp_path):
    grid = preprocess(readings(spark, [r for e in (1, 2, 1500) for r in experiment(e)]), SPEC)
    path = str(tmp_path / "set")
    storage.write_dataset(grid, path)
    storage.write_dataset(grid.where("experiment_id <> 2"), path)
    listed = spark.createDataFrame([(1500,), (7,)], "experiment_id bigint")
    assert {r.experiment_id for r in storage.read_dataset(spark, path, grid.schema).collect()} == {1, 1500}
    assert {r.experiment_id for r in storage.read_dataset(spark, path, grid.schema, listed).collect()} == {1500}


def test_reports_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "report")
    grid = preprocess(readings(spark, [r for e in (1, 2) for r in experiment(e)]), SPEC).select("experiment_id", "idx", f"`{X}`")
    storage.write_report(grid, path)
    storage.write_report(grid.where("experiment_id = 2 and idx < 3"), path)
    back = spark.read.option("header", True).csv(path)
    assert {r.experiment_id: r["count"] for r in back.groupBy("experiment_id").count().collect()} == {1: 120, 2: 3}


def test_reports_in_groups_are_replaced_one_by_one(spark, tmp_path):
    path = tmp_path / "report"
    rows = [(e, i, None if i == 3 else (e or 0) + i / 7) for e in [*range(1, 60), 1001, None] for i in range(5)]
    report = spark.createDataFrame(rows, "experiment_id bigint, idx bigint, `a:b` double")
    storage.write_report(report, str(path), group_size=50)
    untouched = {f: f.stat().st_mtime_ns for f in path.glob("experiment_group=20/*.csv")}
    storage.write_report(report.where("experiment_id in (2, 57) and idx < 2 or experiment_id is null and idx = 4"), str(path), group_size=50)
    back = storage.read_report(spark, str(path), report.schema)
    replaced = [r for r in rows if r[1] < 2 or r[0] not in (2, 57)]
    assert back.columns == ["experiment_id", "idx", "a_b"]
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, (r for r in replaced if r[0] is not None or r[1] == 4)))
    # as many folders as groups, and those without new rows are left alone
    assert len(list(path.glob("experiment_group=*"))) == 4 and len(list(path.glob("experiment_group=*/*.csv"))) <= 8
    assert untouched == {f: f.stat().st_mtime_ns for f in path.glob("experiment_group=20/*.csv")}


def test_choice_of_experiments(spark):
    batch = [r.experiment_id for r in gates.choose_experiments(spark, "second_batch").collect()]
    assert batch == [186, 187, 188, 189, 190]
    assert [r.experiment_id for r in gates.choose_experiments(spark, [9, 5, 9, 4]).collect()] == [5, 9]
    assert gates.choose_experiments(spark, "unknown").count() == 0


def test_truncated_files_cost_their_own_experiments_only(spark, tmp_path):
    df = grid(spark, {e: {"a": noisy(e, 30)} for e in range(1, 41)})
    path = tmp_path / "set"
    storage.write_dataset(df, str(path), group_size=10)
    whole = storage.read_checked(spark, str(path), df.schema, group_size=10)
    assert whole.rejects.count() == 0 and whole.grid.count() == 1200
    broken = sorted(path.glob("experiment_group=1/*.parquet"))[0]
    lost = {r.experiment_id for r in spark.read.parquet(str(broken)).select("experiment_id").distinct().collect()}
    broken.write_bytes(broken.read_bytes()[: broken.stat().st_size // 2])
    # a file of which only the values of a column are damaged
    other = sorted(path.glob("experiment_group=2/*.parquet"))[0]
    hurt = {r.experiment_id for r in spark.read.parquet(str(other)).select("experiment_id").distinct().collect()}
    data = bytearray(other.read_bytes())
    data[: len(data) // 2] = b"\xff" * (len(data) // 2)
    other.write_bytes(bytes(data))
    for crc in path.glob("experiment_group=*/.*.crc"):
        crc.unlink()
    listed = spark.createDataFrame([(i,) for i in range(1, 44)], "experiment_id bigint")
    found = storage.read_checked(spark, str(path), df.schema, listed, group_size=10)
    rejects = {r.experiment_id: (r.stage, r.reason) for r in found.rejects.collect()}
    assert set(rejects) == lost | hurt | {41, 42, 43}
    assert rejects[42] == ("read", "no data set") and all(rejects[e] == ("read", "0 of 30 rows readable") for e in lost)
    kept = found.grid.groupBy("experiment_id").count().collect()
    assert {r.experiment_id for r in kept} == set(range(1, 41)) - lost - hurt and {r["count"] for r in kept} == {30}
    files = {r.path.split("/")[-1] for r in storage.unreadable_files(spark, str(path), df.schema).collect()}
    assert files == {broken.name, other.name}


def test_tables_in_buckets_need_no_exchange(spark, tmp_path):
    rows = readings(spark, [r for e in range(1, 12) for r in experiment(e)])
    spec = WindowSpec((X, T), (X,), (T,), 3, 2)
    limit = SPEC.grid.max_rows
    chain = lambda df: windows.sliding_windows(preprocess(df, SPEC), spec, limit)
    stored = storage.store_by_experiment(rows, "bucketed_readings", "ts", str(tmp_path / "readings"), buckets=4)
    found = chain(stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 1
    assert "Exchange" in chain(rows)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, chain(rows).collect()))
    grid_table = storage.store_by_experiment(preprocess(rows, SPEC), "bucketed_grid", path=str(tmp_path / "grid"), buckets=4)
    again = windows.sliding_windows(series.smooth_centered(series.fill_gaps(grid_table, (X, T), limit), (X, T), 5, max_rows=limit), spec, limit)
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    assert again.count() > 0
