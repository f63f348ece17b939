"""URL filters as a temporal list join.

A list is a table of dated entries: from a date on, a host or domain is blocked or allowed. Entries become validity intervals (each lasts until
the next entry of its key), and an as-of join evaluates every capture against the intervals that cover the date of its fetch. A capture is
looked up under its host and every parent domain; the most specific entry that is active decides.

Scale: the list is looked up once for each host and day, and captures, as id, url and date, join what was decided. Entries are first reduced to one for
each key and day (map-side), so the window that makes intervals sees at most one row per day of a key. Intervals are cut at month ends and
joined on key and month: a host with very many entries meets at most a month's. The captures of a host with a third of all rows join one decision a
day, in a join that Spark can split.

Cases: on one day "block" wins over "allow" for the same key; an entry without key, date or action is ignored; keys are compared in lower case
and without a final dot. A capture whose url is null or has no host, or whose date is null, is not blocked. Rows with equal ids
and repeated rows stay as many rows. Empty lists block nothing; empty captures give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.llm.common import bound

BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and final dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def domains(host: Column) -> Column:
    """The host and its parent domains, longest first."""

    def suffixes(labels: Column) -> Column:
        n = F.size(labels)
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))

    return F.when(host == "", F.array().cast("array<string>")).otherwise(bound(F.split(host, r"\."), suffixes))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (key, action, since, until) from entries (key, day, action); until is exclusive, null for the last one."""
    usable = entries.select(
        F.lower(F.regexp_replace("key", r"\.$", "")).alias("key"), F.col("day").cast("date").alias("day"), "action"
    ).filter(F.col("day").isNotNull() & F.col("action").isin(BLOCK, ALLOW) & (F.col("key") != ""))
    # "block" is the larger of the two names
    daily = usable.groupBy("key", "day").agg(F.max("action").alias("action"))
    following = Window.partitionBy("key").orderBy("day")
    return daily.select("key", "action", F.col("day").alias("since"), F.lead("day").over(following).alias("until"))


def _by_month(valid: DataFrame, first, last) -> DataFrame:
    """Each interval once for every month it touches between the captures' first and last date."""
    begin = F.greatest(F.trunc("since", "month"), F.trunc(F.lit(first).cast("date"), "month"))
    end = F.least(F.coalesce(F.date_sub("until", 1), F.lit(last).cast("date")), F.lit(last).cast("date"))
    touching = valid.filter(begin <= end)
    return touching.withColumn("month", F.explode(F.sequence(begin, F.trunc(end, "month"), F.expr("interval 1 month"))))


def evaluate(
    captures: DataFrame,
    entries: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    day_col: str = "fetched",
) -> DataFrame:
    """Each capture's id, url, day, host, the key, action and since of the deciding entry (null: none) and blocked."""
    rows = captures.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(day_col).cast("date").alias("_day")
    ).withColumn("_host", F.coalesce(host_of(F.col("_url")), F.lit("")))
    limits = rows.agg(F.min("_day"), F.max("_day")).first()
    # what captures of one host and day have in common is decided once
    places = rows.select("_host", "_day").filter((F.col("_host") != "") & F.col("_day").isNotNull()).distinct()
    keys = places.select("_host", "_day", F.explode(domains(F.col("_host"))).alias("key")).withColumn("month", F.trunc("_day", "month"))
    valid = _by_month(intervals(entries), *limits)
    active = keys.join(
        valid,
        (keys["key"] == valid["key"])
        & (keys["month"] == valid["month"])
        & (keys["_day"] >= valid["since"])
        & (valid["until"].isNull() | (keys["_day"] < valid["until"])),
    )
    entry = F.struct(F.length(valid["key"]).alias("n"), valid["key"], "action", "since")
    decided = active.groupBy(F.col("_host").alias("_on"), F.col("_day").alias("_at")).agg(F.max(entry).alias("_e"))
    judged = rows.join(decided, (rows["_host"] == decided["_on"]) & (rows["_day"] == decided["_at"]), "left")
    return judged.select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        F.col("_day").alias(day_col),
        F.col("_host").alias("host"),
        F.col("_e.key").alias("entry"),
        F.col("_e.action").alias("action"),
        F.col("_e.since").alias("since"),
        F.coalesce(F.col("_e.action") == BLOCK, F.lit(False)).alias("blocked"),
    )
