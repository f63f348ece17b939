"""Small helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.session import ship_package

# white space as every operator here takes it, as characters and as a class of a regular expression
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the fast built-in way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda refers to its variable, not to the expression behind it."""
    return F.transform(F.array(value), use)[0]


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns _id, _text (null: empty) and _digest; rows equal in the first and the last are one document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_digest", F.xxhash64("_text"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_digest"] == right["_digest"])


PORTION_BYTES = 4 << 20


def portions(batches, column: int):
    """Slices of Arrow batches whose texts in `column` hold about PORTION_BYTES, a single longer text alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // PORTION_BYTES
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            yield batch.slice(start, stop - start)


def _runs(row: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Spans sorted by row and start as maximal runs (row, start, stop): those of a row that overlap or touch are one."""
    if not len(row):
        return row, start, stop
    # a row's reach lies in front of all spans of the next row
    base = row << 40
    reach = np.maximum.accumulate(base + stop)
    new = np.flatnonzero(np.r_[True, (base + start)[1:] > reach[:-1]])
    last = np.r_[new[1:], len(row)] - 1
    return row[new], start[new], reach[last] - base[new]


def without_spans(documents: DataFrame, removed: DataFrame) -> DataFrame:
    """(_id, n_bytes, n_removed, n_spans, kept): the bytes outside the removed spans for every row of identified() documents."""

    def run(batches):
        for batch in portions(batches, 1):
            listed, texts = batch.column(2), batch.column(1).to_pylist()
            row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False))
            flat = listed.flatten()
            row, start, stop = _runs(row, *(flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            n_spans = np.bincount(row, minlength=len(texts))
            n_removed = np.zeros(len(texts), np.int64)
            np.add.at(n_removed, row, stop - start)
            n_bytes = np.array([len(text) for text in texts], np.int64)
            ends = np.cumsum(n_spans)
            for x in np.flatnonzero(n_spans).tolist():
                own = slice(ends[x] - n_spans[x], ends[x])
                cuts = zip([0, *stop[own].tolist()], [*start[own].tolist(), len(texts[x])])
                texts[x] = b"".join([texts[x][begin:end] for begin, end in cuts])
            arrays = [*map(pa.array, (n_bytes, n_removed, n_spans)), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = documents.join(removed, same_document(documents, removed), "left")
    source = joined.select(documents["_id"], F.col("_text").cast("binary").alias("_text"), "removed")
    kind = documents.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
