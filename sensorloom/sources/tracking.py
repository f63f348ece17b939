"""Run records: runs, parameters, metrics and model versions as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = (
    "run_id string, entrypoint string, status string, commit string, "
    "start_time timestamp, tags map<string,string>"
)
RUN_PARAMS = "run_id string, key string, value string"
RUN_METRICS = "run_id string, key string, value double"
MODEL_VERSIONS = (
    "creation_timestamp timestamp, model_name string, version int, run_id string, "
    "source string, status string, tags map<string,string>"
)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def epoch_metrics(log: DataFrame, run_id: str) -> DataFrame:
    """A run's metric records from its training log: of every metric the value of the last epoch."""
    names = [c for c in log.columns if c != "epoch"]
    last = log.agg(*(F.max_by(F.col(c), "epoch").alias(c) for c in names))
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in names))
    return last.select(F.lit(run_id).alias("run_id"), F.inline(pairs)).where("value IS NOT NULL")


def append_training_log(metrics: DataFrame, path: str) -> None:
    """Add metric rows to a ';'-separated log."""
    metrics.write.mode("append").option("sep", ";").option("header", True).csv(path)


def read_training_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)
