"""Lines that many documents share, found by range-partitioned line hashes and returned as compressed keep bitmaps.

Every line becomes a row of hash, document and position. The rows are range-partitioned by hash and sorted by hash, document and
position, so that the first occurrence of a hash and its changes of document stream past in order. A part of the document id (the salt)
is added to the range key: the rows of a very common line lie in many ranges, and only one row for each line and salt moves on. There are as many salts as
shuffle partitions, so a line that every document has spreads over the whole cluster.
The text itself never takes part. The result is a run-length compressed bitmap for each document.

Cases: a null or empty text is one empty line. Lines without characters after stripping are never dropped. Rows that are equal in id and
text are one document; ids may be null. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.llm.common import BLANKS, bound, identified, lower_ascii, same_document
from sensorloom.session import keep

LEAST_SALTS = 32
DROP_ALL = "all"
DROP_REPEATS = "repeats"
_HASH = ("_h1", "_h2")


def line_rows(documents: DataFrame) -> DataFrame:
    """A row for each line that has a key: its 128-bit hash, document, position and salt."""
    salts = max(LEAST_SALTS, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = F.transform(F.split(lower_ascii(F.col("_text")), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    lines = documents.select("_id", "_digest", F.posexplode(keys).alias("_pos", "_key")).filter(F.length("_key") > 0)
    return lines.select(
        F.xxhash64("_key").alias("_h1"),
        F.xxhash64(F.lit(1), "_key").alias("_h2"),
        F.pmod(F.xxhash64("_id", "_digest"), F.lit(salts)).cast("int").alias("_salt"),
        "_id",
        "_digest",
        "_pos",
    )


def common_lines(lines: DataFrame, min_documents: int) -> DataFrame:
    """Hashes of the lines in at least min_documents documents, with their first occurrence."""
    ranged = lines.repartitionByRange(*_HASH, "_salt")
    in_order = Window.partitionBy(*_HASH, "_salt").orderBy("_id", "_digest", "_pos")
    place = F.struct("_id", "_digest", "_pos")
    document = F.struct("_id", "_digest")
    streamed = ranged.select(
        *_HASH,
        "_salt",
        F.when(document == F.lag(document).over(in_order), 0).otherwise(1).alias("_new"),
        place.alias("_place"),
    )
    by_salt = streamed.groupBy(*_HASH, "_salt").agg(F.sum("_new").alias("_documents"), F.min("_place").alias("_first"))
    total = by_salt.groupBy(*_HASH).agg(F.sum("_documents").alias("_documents"), F.min("_first").alias("_first"))
    return total.filter(F.col("_documents") >= min_documents)


def _runs(positions: Column) -> Column:
    """Sorted positions as runs (start, length)."""

    def pair(ordered: Column) -> Column:
        starts = F.filter(ordered, lambda p, i: (i == 0) | (F.get(ordered, i - 1) != p - 1))
        ends = F.filter(ordered, lambda p, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1) != p + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))

    return bound(F.array_sort(positions), pair)


def _bitmap(runs: Column, n_lines: Column) -> Column:
    """Lengths of alternately kept and dropped runs of lines, the first one kept (and maybe 0)."""

    def lengths(dropped: Column) -> Column:
        def before(i: Column) -> Column:
            return F.when(i == 0, 0).otherwise(F.get(dropped, i - 1)["start"] + F.get(dropped, i - 1)["length"])

        pairs = F.flatten(F.transform(dropped, lambda run, i: F.array(run["start"] - before(i), run["length"])))
        return F.concat(pairs, F.array(n_lines - before(F.size(dropped))))

    return F.when(runs.isNull(), F.array(n_lines)).otherwise(bound(runs, lengths))


def keep_bitmaps(
    docs: DataFrame,
    *,
    min_documents: int = 10,
    drop: str = DROP_ALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns _id, _digest, n_lines, n_dropped and keep, the bitmap, for every document.

    drop="all" drops every line that at least min_documents documents have; drop="repeats" leaves its first occurrence in place.
    """
    documents = identified(docs, id_col, text_col)
    lines = line_rows(documents)
    # stored, so that both sides of the join are plain exchanges, which Spark can split at a common line
    common = keep(common_lines(lines, min_documents), "common-lines")
    marked = lines.join(common, list(_HASH))
    if drop == DROP_REPEATS:
        marked = marked.filter(F.struct(lines["_id"], lines["_digest"], lines["_pos"]) != F.col("_first"))
    dropped = (
        marked.groupBy(lines["_id"], lines["_digest"])
        .agg(F.collect_set(lines["_pos"]).alias("_positions"))
        .select("_id", "_digest", F.size("_positions").alias("_n"), _runs(F.col("_positions")).alias("_runs"))
    )
    every = documents.select("_id", "_digest", F.size(F.split("_text", "\n")).alias("n_lines")).distinct()
    return every.join(dropped, same_document(every, dropped), "left").select(
        every["_id"],
        every["_digest"],
        F.col("n_lines").cast("long"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"),
        _bitmap(F.col("_runs"), F.col("n_lines")).alias("keep"),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of text that the bitmap keeps, joined by line feeds."""
    flags = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    pairs = F.arrays_zip(F.split(text, "\n").alias("line"), flags.alias("kept"))
    lines = F.transform(F.filter(pairs, lambda p: p["kept"]), lambda p: p["line"])
    return F.when(F.size(keep) == 1, text).otherwise(F.array_join(lines, "\n"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, n_lines, n_dropped and kept text."""
    documents = identified(docs, id_col, text_col)
    joined = documents.join(bitmaps, same_document(documents, bitmaps))
    return joined.select(
        documents["_id"].alias(id_col),
        "n_lines",
        "n_dropped",
        kept_text(F.col("_text"), F.col("keep")).alias("kept"),
    )
