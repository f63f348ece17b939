"""Global and per-group row numbers without one task seeing all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.session import keep

BUCKET_ROWS = 1 << 18
# buckets are added up in so many stretches at most
STRETCHES = 1024


def number_rows(
    df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "position", total: str | None = None, buckets: int | None = None
) -> DataFrame:
    """0-based positions of rows ordered by (bucket, order) within keys.

    Rows are numbered inside each bucket; the rows in front of a bucket come from a table of bucket counts. bucket must not decrease along order.
    With no keys, bucket is a number below `buckets`, and counts are added up on two levels: within stretches of neighbouring buckets, and over
    the stretches, of which there are at most STRETCHES. total names a column for the group's row count.
    """
    df = df.withColumn("_bucket", bucket)
    groups = [*keys, "_bucket"]
    counts = df.groupBy(*groups).agg(F.count("*").alias("_n"))
    offsets = _within(counts, keys, groups) if keys else _on_two_levels(counts, buckets)
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1).join(offsets.hint("shuffle_hash"), groups)
    numbered = numbered.withColumn(name, (F.col("_offset") + F.col("_row")).cast("long"))
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop("_bucket", "_row", "_offset", "_total")


def _within(counts: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    over = Window.partitionBy(*keys)
    ahead = over.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(*groups, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"), F.sum("_n").over(everything).alias("_total"))


def _on_two_levels(counts: DataFrame, buckets: int) -> DataFrame:
    size = max(1, math.ceil(buckets / STRETCHES))
    placed = counts.withColumn("_stretch", F.call_function("div", F.col("_bucket"), F.lit(size).cast("long")))
    entry = F.struct("_stretch", F.col("_n").alias("n"))
    # one row, an entry for each stretch
    listed = placed.groupBy("_stretch").agg(F.sum("_n").alias("_n")).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before"))
    summed = F.aggregate(
        "all", start, lambda a, e: F.struct((a["sum"] + e["n"]).alias("sum"), F.array_append(a["before"], a["sum"]).alias("before"))
    )
    stretches = listed.select("all", summed.alias("s")).select(
        F.explode(F.arrays_zip(F.col("all")["_stretch"].alias("stretch"), F.col("s")["before"].alias("before"))).alias("e"),
        F.col("s")["sum"].alias("_total"),
    )
    stretches = stretches.select(F.col("e")["stretch"].alias("_stretch"), F.col("e")["before"].alias("_before"), "_total")
    ahead = Window.partitionBy("_stretch").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_inside", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    return inside.join(stretches, "_stretch").select("_bucket", (F.col("_before") + F.col("_inside")).alias("_offset"), "_total")


def shuffled(
    df: DataFrame, digest: Column, ties: list, name: str = "position", total: str | None = None
) -> DataFrame:
    """Positions of all rows in the order of a digest, ties broken by the given columns.

    The rows are stored first, as they are counted and then numbered; give keys only. The digest's first hex digits are the
    bucket, as many as make even ranges of at most about BUCKET_ROWS rows whatever the keys hold.
    """
    stored = keep(df.withColumn("_digest", digest), "order")
    digits = max(1, math.ceil(math.log(max(1.0, stored.count() / BUCKET_ROWS), 16)))
    bucket = F.conv(F.substring("_digest", 1, digits), 16, 10).cast("long")
    return number_rows(stored, [], bucket, ["_digest", *ties], name, total, 16**digits).drop("_digest")
