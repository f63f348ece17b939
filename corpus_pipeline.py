"""A training corpus from raw documents: five stages, each one operator over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents; its result is written before the next one reads it. Extra
columns of documents pass through. Decisions are taken for each id and text together: rows equal in both are one document and share their fate,
rows with the same id and other texts, and rows without an id, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from sensorloom.llm.common import table
from sensorloom.llm.queries import MARGINS, ROUNDS, with_margins
from sensorloom.session import fresh_path, scratch, ship_package


def _key(docs: DataFrame) -> DataFrame:
    """The documents with their id and text digest as one column, the identity of a document for every decision."""
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.struct(F.col("doc_id").alias("id"), digest.alias("digest")).alias("key"), "text", "source", "lang")


def _only(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose document (column key) is not rejected."""
    out = rejected.select(F.col("key.id").alias("_out_id"), F.col("key.digest").alias("_out_digest")).distinct()
    digest = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(out, docs["doc_id"].eqNullSafe(out["_out_id"]) & (digest == out["_out_digest"]), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected grade is on the clean side."""
    ship_package(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _only(docs, toxicity.score(_key(docs), model, id_col="key").filter("toxic"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the repeats of lines that ten or more documents have; the first occurrence of such a line stays.

    n_chars follows the text. Every document stays, if need be with an empty text; a null text becomes empty.
    """
    ship_package(spark)
    bitmaps = line_dedup.keep_bitmaps(docs, min_documents=10, drop=line_dedup.DROP_REPEATS)
    digest = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    keys = bitmaps.select(F.col("_id").alias("__id"), F.col("_digest").alias("__digest"), F.col("keep").alias("__keep"))
    joined = docs.join(keys, docs["doc_id"].eqNullSafe(keys["__id"]) & (digest == keys["__digest"]))
    text = line_dedup.kept_text(F.coalesce(docs["text"], F.lit("")), keys["__keep"])
    changed = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return joined.select(*(changed[c].alias(c) if c in changed else docs[c] for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (null first).

    The operator's own measure: fingerprints of three-word shingles that differ in at most three bits.
    """
    ship_package(spark)
    found = simhash.near_duplicates(_key(docs), width=3, bits=3, id_col="key")
    return _only(docs, found.filter("key <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    ship_package(spark)
    found = decontaminate.matches(_key(docs), table(spark, sf_dir, "benchmark"), id_col="key")
    return _only(docs, found.filter(F.size("spans") > 0))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the budget's share of all tokens, with the target shares by source, language and topic as far as their tokens go."""
    ship_package(spark)
    drawn = mixing.mixed(with_margins(_key(docs), "key"), MARGINS, rounds=ROUNDS, id_col="key")
    return _only(docs, drawn.filter(~F.col("sampled")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

# fingerprints and a fitted model have no SQL form; tests compare the stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
