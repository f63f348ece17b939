"""Matching earlier runs, stale runs, run tables and model versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import names
from sensorloom.settings import FILE_DEPENDENCIES, RELEVANT_SECTIONS

IGNORED = ("normalization_ranges",)
IGNORED_FOR_AUGMENTATION = ("min_nr_experiments", "max_nr_experiments")


def wanted_params(config: dict, entrypoint: str, ignore: tuple[str, ...] = IGNORED) -> dict[str, str]:
    """The parameters, as strings, that an earlier run of the entry point must agree with."""
    skipped = set(ignore)
    if entrypoint == "generate_artificial_data":
        skipped.update(IGNORED_FOR_AUGMENTATION)
    return {
        key: str(value)
        for section in RELEVANT_SECTIONS[entrypoint]
        for key, value in config.get(section, {}).items()
        if key not in skipped
    }


def matching_runs(
    runs: DataFrame, params: DataFrame, entrypoint: str, wanted: dict[str, str], stale: DataFrame | None = None
) -> DataFrame:
    """Finished runs of an entry point whose parameters all equal the wanted ones, newest first.

    A parameter a run lacks counts as 'None'; further parameters of a run do not matter. Runs in
    stale (run_id) are left out.
    """
    candidates = runs.where((_entry_point() == entrypoint) & (F.col("status") == "FINISHED"))
    if stale is not None:
        candidates = candidates.join(stale.select("run_id"), "run_id", "left_anti")
    if wanted:
        keys = list(wanted)
        picked = (
            params.where(F.col("key").isin(keys))
            .groupBy("run_id")
            .agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"p:{k}") for k in keys])
        )
        agree = reduce(
            lambda a, b: a & b, [F.coalesce(names.col(f"p:{k}"), F.lit("None")) == v for k, v in wanted.items()]
        )
        candidates = candidates.join(picked, "run_id", "left").where(agree).select(*[F.col(c) for c in runs.columns])
    return candidates.orderBy(F.desc("start_time"), F.desc("run_id"))


def match_run(*args, **options) -> DataFrame:
    """The newest matching run, as one row or none."""
    return matching_runs(*args, **options).limit(1)


def file_dependencies(spark) -> DataFrame:
    rows = [(f, s) for f, stages in FILE_DEPENDENCIES.items() for s in stages]
    return spark.createDataFrame(rows, "file string, stage string")


def stale_runs(runs: DataFrame, changed_files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Runs whose entry point depends on a file changed since their commit.

    changed_files is (commit, file): the files that differ between that commit and the present one.
    """
    touched = changed_files.join(dependencies, "file").select("commit", F.col("stage").alias("entrypoint")).distinct()
    return runs.join(touched, ["commit", "entrypoint"], "left_semi")


def run_values(params: DataFrame, metrics: DataFrame) -> DataFrame:
    """The run table in long form (run_id, key, value), for any number of keys."""
    both = params.select("run_id", "key", F.col("value").alias("param"), F.lit(None).cast("string").alias("metric")).unionByName(
        metrics.select("run_id", "key", F.lit(None).cast("string").alias("param"), F.col("value").cast("string").alias("metric"))
    )
    return both.groupBy("run_id", "key").agg(F.coalesce(F.max("metric"), F.max("param")).alias("value"))


def run_table(params: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run with a text column per key; a metric wins over a parameter of its name."""
    both = params.select("run_id", "key", F.col("value").alias("param"), F.lit(None).cast("double").alias("metric")).unionByName(
        metrics.select("run_id", "key", F.lit(None).cast("string").alias("param"), F.col("value").alias("metric"))
    )
    return both.groupBy("run_id").agg(
        *[
            F.coalesce(
                F.max(F.when(F.col("key") == k, F.col("metric"))).cast("string"),
                F.max(F.when(F.col("key") == k, F.col("param"))),
            ).alias(k)
            for k in keys
        ]
    )


def run_lineage(runs: DataFrame, matched_run_id: Column | None = None) -> DataFrame:
    """The data-set run each run was fed by: one of two tags, else a matched run."""
    sources = [_text(F.col("tags"), "generate_dataset_run_id"), _text(F.col("tags"), "run_id_generate_dataset")]
    if matched_run_id is not None:
        sources.append(matched_run_id.cast("string"))
    return runs.select("run_id", F.coalesce(*sources).alias("dataset_run_id"))


def matched_lineage(runs: DataFrame, params: DataFrame, keys: list[str], entrypoint: str = "generate_dataset") -> DataFrame:
    """run_lineage whose third source is the newest finished run of the entry point with the run's own values of the keys.

    A parameter a run lacks counts as 'None'.
    """
    picked = params.where(F.col("key").isin(keys)).groupBy("run_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"p:{k}") for k in keys]
    )
    filled = [F.coalesce(names.col(f"p:{k}"), F.lit("None")) for k in keys]
    configured = runs.join(picked, "run_id", "left").withColumn("_config", F.to_json(F.array(*filled)))
    finished = (_entry_point() == entrypoint) & (F.col("status") == "FINISHED")
    newest = configured.where(finished).groupBy("_config").agg(
        F.max_by("run_id", F.struct("start_time", "run_id")).alias("_matched")
    )
    return run_lineage(configured.join(newest, "_config", "left"), F.col("_matched"))


def predict_models(models: DataFrame, suffix_only: bool = False) -> DataFrame:
    """Models for prediction: '_predict' anywhere in the name, or only at its end."""
    name = F.col("model_name")
    return models.where(name.endswith("_predict") if suffix_only else name.contains("_predict"))


def model_versions(models: DataFrame, versions: DataFrame) -> DataFrame:
    """All versions of each model."""
    return models.select("model_name").distinct().join(versions, "model_name")


def newest_version(versions: DataFrame) -> DataFrame:
    """The last version of each model by time, then number, then run."""
    key = F.struct("creation_timestamp", "version", "run_id")
    newest = versions.groupBy("model_name").agg(
        F.max_by(F.struct("version", "run_id", "creation_timestamp"), key).alias("_newest")
    )
    return newest.select("model_name", "_newest.*")


def objective(metrics_val: Column, metrics_loss: Column) -> Column:
    """Validation loss, else training loss; NULL where it is negative or not a number."""
    value = F.coalesce(metrics_val, metrics_loss)
    return F.when(~F.isnan(value) & (value >= 0.0), value)


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the smallest objective, the earliest of equals; trials without one do not count."""
    key = F.struct("objective", "trial")
    counted = trials.where(F.col("objective").isNotNull())
    return counted.agg(F.min_by(F.struct(*counted.columns), key).alias("_best")).where(
        F.col("_best").isNotNull()
    ).select("_best.*")


def _entry_point() -> Column:
    """What a run executed: the project's tag if it has one, else the run's own record."""
    return F.coalesce(_text(F.col("tags"), "mlflow.project.entryPoint"), F.col("entrypoint"))


def _text(tags: Column, key: str) -> Column:
    value = F.try_element_at(tags, F.lit(key))
    return F.when(F.length(value) > 0, value)
