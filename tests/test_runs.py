from datetime import datetime

from pyspark.sql import functions as F

from sensorloom.operators import runs
from sensorloom.sources import tracking
from workload import tracking as queries


def tables(spark):
    day = lambda d: datetime(2024, 1, d)
    records = spark.createDataFrame(
        [
            ("1", "train", "FINISHED", "c1", day(1), {}),
            ("2", "train", "FINISHED", "c2", day(2), {}),  # one parameter differs
            ("3", "train", "FINISHED", "c1", day(3), {}),  # lacks a parameter
            ("4", "train", "FAILED", "c1", day(4), {}),
            ("5", "other", "FINISHED", "c1", day(5), {"mlflow.project.entryPoint": "train"}),  # has one more
            ("6", "train", "FINISHED", "c1", day(6), {"mlflow.project.entryPoint": "other"}),
            ("7", "train", "FINISHED", "c3", day(7), {"generate_dataset_run_id": "70"}),
        ],
        tracking.RUNS,
    )
    params = []
    for run, values in {
        1: {"a": "1", "b": "x"}, 2: {"a": "2", "b": "x"}, 3: {"a": "1"}, 4: {"a": "1", "b": "x"},
        5: {"a": "1", "b": "x", "z": "9"}, 6: {"a": "1", "b": "x"}, 7: {"a": "1", "b": "x"},
    }.items():
        params += [(str(run), k, v) for k, v in values.items()]
    return records, spark.createDataFrame(params, tracking.RUN_PARAMS)


def ids(df):
    return [r.run_id for r in df.collect()]


def test_matching(spark):
    records, params = tables(spark)
    assert ids(runs.matching_runs(records, params, "train", {"a": "1", "b": "x"})) == ["7", "5", "1"]
    assert ids(runs.match_run(records, params, "train", {"a": "1", "b": "x"})) == ["7"]
    assert ids(runs.matching_runs(records, params, "train", {"a": "1", "b": "None"})) == ["3"]
    assert ids(runs.match_run(records, params, "train", {"a": "5"})) == []


def test_stale_runs_do_not_match(spark):
    records, params = tables(spark)
    changed = spark.createDataFrame([("c3", "train.py"), ("c1", "notes.md")], "commit string, file string")
    stale = runs.stale_runs(records, changed, runs.file_dependencies(spark))
    assert ids(stale) == ["7"]
    assert ids(runs.match_run(records, params, "train", {"a": "1", "b": "x"}, stale)) == ["5"]


def test_wanted_params():
    config = {
        "dataset": {"substance": "aa", "min_nr_experiments": 3, "normalization_ranges": {"x": [0, 1]}},
        "training": {"nr_epochs": 5},
        "paths": {"p": 1},
    }
    assert runs.wanted_params(config, "generate_artificial_data") == {"substance": "aa"}
    assert runs.wanted_params(config, "train") == {"substance": "aa", "min_nr_experiments": "3", "nr_epochs": "5"}


def test_run_table_prefers_metrics(spark):
    params = spark.createDataFrame([("1", "a", "x"), ("1", "b", "y"), ("2", "c", "z")], tracking.RUN_PARAMS)
    metrics = spark.createDataFrame([("1", "b", 0.5)], tracking.RUN_METRICS)
    table = runs.run_table(params, metrics, ["a", "b", "c"])
    assert table.columns == ["run_id", "a", "b", "c"]
    assert sorted(tuple(r) for r in table.collect()) == [("1", "x", "0.5", None), ("2", None, None, "z")]
    long = sorted(tuple(r) for r in runs.run_values(params, metrics).collect())
    assert long == [("1", "a", "x"), ("1", "b", "0.5"), ("2", "c", "z")]


def test_lineage_and_best_trial(spark):
    records, params = tables(spark)
    own = {r.run_id: r.dataset_run_id for r in runs.matched_lineage(records, params, ["a", "b"], "train").collect()}
    assert own["2"] == "2" and own["3"] == "3" and own["6"] == "7" and own["7"] == "70"
    found = {r.run_id: r.dataset_run_id for r in runs.run_lineage(records, F.lit("9be77d")).collect()}
    assert found["7"] == "70" and found["1"] == "9be77d"
    rows = spark.createDataFrame(
        [(0, None, 0.4), (1, float("nan"), 0.1), (2, -1.0, 0.2), (3, 0.3, 0.9), (4, 0.3, 0.1)],
        "trial int, val_loss double, loss double",
    )
    trials = rows.withColumn("objective", runs.objective(F.col("val_loss"), F.col("loss")))
    assert [r.objective for r in trials.orderBy("trial").collect()] == [0.4, None, None, 0.3, 0.3]
    assert runs.best_trial(trials).first().trial == 3
    assert runs.best_trial(trials.where("objective is null")).count() == 0


def test_csv_and_log(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5)], "run_id bigint, name string, loss double")
    tracking.write_csv(table, str(tmp_path / "csv"))
    assert sorted(tracking.read_csv(spark, str(tmp_path / "csv"), "run_id bigint, name string, loss double").collect()) == sorted(table.collect())
    for _ in range(2):
        tracking.append_training_log(table, str(tmp_path / "log"))
    log = tracking.read_training_log(spark, str(tmp_path / "log"), "run_id bigint, name string, loss double")
    assert log.count() == 4


def test_run_table_brings_the_lines_of_a_run_together_once(spark, tmp_path):
    rows = [(o, n, f"{'NRA'[o % 3]}", "F", (o * n % 11) / 100) for o in range(1, 60) for n in range(1, 8) if (o + n) % 5] + [(3, 1, "A", "A", 0.09)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double").write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    found = queries.run_table(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 2 and "hashpartitioning(run_id, key" not in plan
    got = {r.run_id: r for r in found.collect()}
    assert len(got) == 59 and got["3"].line1 == "AA" and got["3"].line2 is None and got["4"].line2 == "RF" and got["4"].metric2 == "0.08"
    assert got["3"].metric1 == str(round((0.03 + 0.09) / 2, 4))
