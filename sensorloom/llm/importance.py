"""Documents drawn towards a target distribution by the importance of their hashed word runs.

Every run of one to three words falls into one of BUCKETS buckets by its checksum. A bucket's gain is the logarithm of how much more often the target's
features fall into it than the corpus's, as an integer; a document's weight is the sum of the gains of its features, looked up in the array of gains.
Gumbel noise from the seed and the row's id makes the largest scores a draw without replacement by weight.

The draw is exact at any size. The corpus is counted in a first pass, one sum of BUCKETS counts a task, and scored in a second one, which writes a
narrow table of keys; both read the text alone and shuffle nothing of it. The cut-off key is found by weighted medians of medians over that table
(selection.py). Only the winners are sorted, in ranges, and numbered by the rows of the ranges in front; the rest takes no part in a sort or join.

Keys are the score (descending), the id, a digest of the text and the row's place in the stored table, so all are different: ties go to the smaller id.

Cases: null and empty texts have no features, weight 0 and no rank. Rows with equal ids get the same noise, each its own weight, and are ordered by the
digest of their texts; equal rows by their place, which shows in nothing. Null ids are drawn as the empty id and come after the others of a score. Ids
that are not integers are ordered by a digest. A row of the target without words adds nothing; an empty target leaves gains by the corpus alone. Empty tables
give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import portions
from sensorloom.llm.selection import kth_key
from sensorloom.session import keep

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
# A-Z to a-z; every other byte below 128 that is no letter or digit parts words
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 20


def _word_pieces(text: bytes):
    """The words of a text, in lists of about _PIECE bytes."""
    plain, start = text.translate(_TABLE), 0
    while start < len(plain):
        end = plain.find(b" ", start + _PIECE)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def feature_buckets(text: bytes | None, buckets: int = BUCKETS, longest: int = LONGEST):
    """(number of words, buckets of all features) piece by piece; a run's checksum goes on from that of the run without its last word."""
    # checksums of the runs of 1, 2, ... words that end with the last word of the pieces before
    ahead: list[int | None] = [None] * longest
    for words in _word_pieces(text or b""):
        if not words:
            continue
        spaced = [b" " + w for w in words]
        level = list(map(crc32, words, repeat(0)))
        found, last = list(level), [level[-1]]
        for carried in ahead[:-1]:
            before = level[:-1] if carried is None else [carried, *level[:-1]]
            level = list(map(crc32, spaced[len(spaced) - len(before) :], before))
            found += level
            last.append(level[-1] if level else None)
        ahead = last
        yield len(words), np.array(found, np.uint32) % buckets


def bucket_counts(docs: DataFrame, *, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all documents fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in portions([batch], 0):
                for text in part.column(0).to_pylist():
                    for _, found in feature_buckets(text, buckets):
                        total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    parts = docs.select(F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, "bucket bigint, n bigint")
    counts = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) for each bucket."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1.0) * (s + n)) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths from the digest of seed and id."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gain: np.ndarray, *, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _digest, n_words, n_features, weight, score) of every row."""
    buckets = len(gain)

    def run(batches):
        for batch in portions(batches, 1):
            words, features, weights = [], [], []
            for text in batch.column(1).to_pylist():
                n, m, weight = 0, 0, 0
                for k, found in feature_buckets(text, buckets):
                    n, m, weight = n + k, m + len(found), weight + int(gain[found].sum())
                words.append(n), features.append(m), weights.append(weight)
            numbers = [pa.array(v, pa.int64()) for v in (words, features, weights)]
            names = ["_id", "_digest", "_noise", "n_words", "n_features", "weight"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *numbers], names)

    source = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), F.xxhash64(text_col).alias("_digest"), noise(id_col, seed).alias("_noise")
    )
    kind = docs.schema[id_col].dataType.simpleString()
    done = source.mapInArrow(run, f"_id {kind}, _digest bigint, _noise bigint, n_words bigint, n_features bigint, weight bigint")
    return done.withColumn("score", F.col("weight") + F.col("_noise")).drop("_noise")


KEY = ["_k0", "_k1", "_k2", "_k3", "_k4"]


def _numbered(rows: DataFrame) -> DataFrame:
    """rank: 1, 2, ... in the order of the key, from ranges of the sorted rows and the rows in the ranges before."""
    placed = keep(rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("_at", F.monotonically_increasing_id()), "winners")
    part = F.shiftright("_at", 33)
    before, ahead = 0, []
    # a row for each range
    for row in sorted(placed.groupBy(part.alias("_part")).count().collect()):
        ahead.append((row["_part"], before))
        before += row["count"]
    offsets = rows.sparkSession.createDataFrame(ahead, "_part bigint, _before bigint")
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", part.cast("long")).join(offsets, "_part").withColumn("rank", F.col("_before") + inside + 1)


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = 5,
    min_words: int = MIN_WORDS,
    seed: int = 42,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """Each row's id, n_features, weight, score and rank; rows of at least min_words words with the highest scores are drawn, percent of them, the others have no rank."""
    gain = gains(bucket_counts(docs, text_col=text_col, buckets=buckets), bucket_counts(target, text_col=target_col, buckets=buckets))
    scored = weighted(docs, gain, seed=seed, id_col=id_col, text_col=text_col)
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    order = F.col("_id").cast("long") if whole else F.xxhash64("_id")
    keys = (-F.col("score"), F.col("_id").isNull().cast("long"), F.coalesce(order, F.lit(0)), F.col("_digest"), F.monotonically_increasing_id())
    # one job writes the keys and counts them
    stored = keep(scored.select("_id", "n_words", "n_features", "weight", "score", *(k.alias(c) for k, c in zip(keys, KEY))), "keys")
    fit = F.col("n_words") >= min_words
    drawn = stored.where(fit).count() * percent // 100
    names = [F.col("_id").alias(id_col), "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if drawn == 0:
        return stored.select(*names, unranked)
    limit = kth_key(stored.where(fit).select(*KEY), drawn - 1)
    ahead = F.struct(*KEY) <= F.struct(*(F.lit(v).cast("long").alias(c) for v, c in zip(limit, KEY)))
    winners = _numbered(stored.where(fit & ahead))
    return winners.select(*names, "rank").unionByName(stored.where(~(fit & ahead)).select(*names, unranked))
