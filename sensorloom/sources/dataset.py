"""Prepared data sets, experiment lists and reports on storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions import names
from sensorloom.session import keep


GROUP_SIZE = 1000
GROUP = "experiment_group"
WRITE_ROWS = 1_000_000
# the rows of each stored experiment; readers of the data itself pass over names like this one
WRITTEN = "_written"


def write_dataset(grid: DataFrame, path: str, group_size: int = GROUP_SIZE) -> None:
    """Store a grid in place of what the path held, in folders of neighbouring experiment ids.

    One folder per experiment (group_size 1) suits small sets only. Rows are spread by experiment and
    position, so a very long experiment is written by several tasks, and sorted, so that a reader of
    few experiments skips most row groups. The rows of each experiment are listed beside them, which read_checked needs.
    """
    (
        _spread(grid.withColumn(GROUP, _group(group_size)))
        .sortWithinPartitions(GROUP, "experiment_id", "idx")
        .write.partitionBy(GROUP)
        .mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .parquet(path)
    )
    counted = grid.sparkSession.read.parquet(path).groupBy("experiment_id").agg(F.count("*").alias("rows"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/{WRITTEN}")


@dataclass(frozen=True)
class Checked:
    grid: DataFrame
    rejects: DataFrame  # experiment_id, stage, reason


def read_checked(
    spark: SparkSession, path: str, schema: T.StructType, experiments: DataFrame | None = None, group_size: int = GROUP_SIZE
) -> Checked:
    """As read_dataset, but files that cannot be read cost their own experiments only.

    Spark leaves such a file out, or the rest of it, without a word. So the rows that all columns can be read of are counted per experiment and
    compared with the rows written: an experiment that lacks any is turned away whole, and so is a listed one that was never written.
    """
    stored = _readable(spark, path, schema)
    values = F.hash(*[names.col(c) for c in schema.fieldNames()])
    found = stored.groupBy("experiment_id").agg(F.count(values).alias("_found"))
    written = spark.read.schema("experiment_id bigint, rows bigint").parquet(f"{path}/{WRITTEN}")
    listed = written if experiments is None else experiments.select("experiment_id").distinct().join(written, "experiment_id", "left")
    audit = keep(listed.join(found, "experiment_id", "left").withColumn("_found", F.coalesce("_found", F.lit(0))), "audit")
    whole = audit.where(F.col("_found") == F.col("rows")).select("experiment_id").withColumn(GROUP, _group(group_size))
    short = F.format_string("%d of %d rows readable", F.col("_found"), F.col("rows"))
    rejects = audit.where(F.col("rows").isNull() | (F.col("_found") != F.col("rows"))).select(
        "experiment_id", F.lit("read").alias("stage"), F.coalesce(F.when(F.col("rows").isNotNull(), short), F.lit("no data set")).alias("reason")
    )
    kept = stored.join(whole, [GROUP, "experiment_id"], "left_semi").select(*[names.col(c) for c in schema.fieldNames()])
    return Checked(kept, rejects)


def unreadable_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(path) of the data files of which not one row can be read."""
    columns = [names.col(c) for c in schema.fieldNames()]
    seen = _readable(spark, path, schema).select(F.col("_metadata.file_path").alias("path"), F.hash(*columns).alias("_h"))
    return spark.read.format("binaryFile").load(path).select("path").join(seen.groupBy("path").agg(F.max("_h")), "path", "left_anti")


def _readable(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(GROUP, T.LongType())])
    return spark.read.schema(full).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)


def read_dataset(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    experiments: DataFrame | None = None,
    group_size: int = GROUP_SIZE,
) -> DataFrame:
    """A stored data set, cut to the experiments of a list (experiment_id) if one is given.

    The list also names the folders, which Spark then prunes while it runs.
    """
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField(GROUP, T.LongType())])).parquet(path)
    if experiments is not None:
        listed = experiments.select("experiment_id").distinct().withColumn(GROUP, _group(group_size))
        stored = stored.join(listed, [GROUP, "experiment_id"], "left_semi")
    return stored.select(*[names.col(c) for c in schema.fieldNames()])


def store_by_experiment(
    rows: DataFrame, table: str, order: str = "idx", path: str | None = None, buckets: int | None = None
) -> DataFrame:
    """Store readings or a grid as a table in buckets of experiments, and return it.

    What groups or windows by experiment then needs no exchange: chunk sums, extents, filling, smoothing and windows read their bucket and go on in the
    same task. It suits experiments that a limit keeps small against a bucket; a table in which one experiment may hold a large share of all rows is
    better stored by write_dataset. buckets: as many as the session's shuffle partitions if not given; path: where the table lies, else the warehouse.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one task and one file for each bucket
    dealt = rows.repartition(buckets, "experiment_id")
    writer = dealt.write.bucketBy(buckets, "experiment_id").sortBy("experiment_id", order).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def _group(group_size: int) -> Column:
    return F.floor(F.col("experiment_id") / group_size)


def _spread(grid: DataFrame) -> DataFrame:
    # a named number of partitions is kept as it is, where tasks of many small folders would be merged
    tasks = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grid.repartition(tasks, "experiment_id", F.floor(F.col("idx") / WRITE_ROWS))


def write_experiment_list(experiments: DataFrame, path: str) -> None:
    """One id per line, ascending over the files."""
    ids = experiments.select("experiment_id").distinct().orderBy("experiment_id")
    ids.select(F.col("experiment_id").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_experiment_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_experiment_list(spark.read.text(path), "value")


def parse_experiment_list(lines: DataFrame, column: str) -> DataFrame:
    """Ids from lines of text: line ends stripped, blank lines dropped."""
    text = F.trim(F.regexp_replace(F.col(column), r"[\r\n]", ""))
    number = F.when(F.length(text) > 0, text).cast("long")
    return lines.where(F.length(text) > 0).select(number.alias("experiment_id"))


def write_report(report: DataFrame, path: str, group_size: int | None = None) -> None:
    """CSV files of a report; an experiment written again replaces its old rows, all others stay as they are.

    Without group_size every experiment has a folder of its own, which suits small sets only: each folder costs a file, a step of the driver at the
    commit and one of the listing. With it, group_size neighbouring ids share a folder, to be read by read_report; a folder that gets new rows is
    written anew with the other experiments' rows, so what it holds and the report must agree in their columns.
    """
    plain = report.toDF(*[c.replace(":", "_") for c in report.columns])
    folder = "experiment_id"
    if group_size is None:
        ordered = _spread(plain).sortWithinPartitions("experiment_id", "idx")
    else:
        folder = GROUP
        # the rows are read for their ids and for the ranges of the sort too: go on from a stored table
        rows = keep(plain, "report").withColumn(GROUP, _group(group_size))
        if _exists(report.sparkSession, path):
            rows = rows.unionByName(_staying(rows, path))
        tasks = int(report.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.repartitionByRange(tasks, "experiment_id", "idx").sortWithinPartitions(GROUP, "experiment_id", "idx")
    (
        ordered.write.option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy(folder)
        .mode("overwrite")
        .csv(path)
    )


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A report written with a group_size; schema is the report's."""
    return _read_groups(spark, path, schema).drop(GROUP)


def _read_groups(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    fields = [T.StructField(f.name.replace(":", "_"), f.dataType) for f in schema.fields]
    full = T.StructType([*fields, T.StructField(GROUP, T.LongType())])
    # other names in a file's header are an error
    return spark.read.schema(full).option("header", True).option("enforceSchema", False).csv(path)


def _staying(rows: DataFrame, path: str) -> DataFrame:
    """What the stored report holds of other experiments in the folders that rows go to."""
    plain = rows.drop(GROUP)
    stored = _read_groups(rows.sparkSession, path, plain.schema)
    groups = rows.select(F.col(GROUP).alias("_group")).distinct()
    ids = rows.select(F.col("experiment_id").alias("_id")).distinct()
    touched = stored.join(groups, F.col(GROUP).eqNullSafe(F.col("_group")), "left_semi")
    return touched.join(ids, F.col("experiment_id").eqNullSafe(F.col("_id")), "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_json(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").json(path)


def project(grid: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Keys and the columns of one role."""
    return grid.select("experiment_id", "idx", *[names.col(f) for f in features])
