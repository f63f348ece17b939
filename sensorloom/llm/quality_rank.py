"""A quality score of documents learnt from preferences: Bradley-Terry ranking, then a threshold at a quantile of the scores.

A text labelled good is preferred to one labelled bad. P(a is preferred to b) = sigmoid(w . (x_a - x_b)), so w is a logistic regression without constant on feature
differences. x describes how a text is written, never its words: the shares of all steps from one kind of byte to another, and a few measures of
words, lines and redundancy over the whole text.

All labelled rows take part. Each row of the larger class meets MATCHES rows of the other, drawn by position in an order of digests, so pairs grow with the rows and
no row meets a whole class. The pairs' differences are written once; every Newton step is one pass over them, in which each task adds up its gradient and curvature,
numbers whose size the features fix, and Spark sums them. The threshold is the quantile of the labelled rows' scores at the share of bad labels, half way between
the two scores next to it; both are exact, found by medians of medians (selection.py). The score 1 / (1 + exp(-(w . x - threshold) - logit(CUT))) is CUT at the threshold.

Texts are read once: features of all rows are written, 360 bytes a row. Scores are rounded to nine digits, as sums of floats depend on the partitioning.

Cases: null and empty texts have the features of a text without bytes and are scored like others. Labels that are null or name no document are left out; of several
labels of an id the highest counts; of rows with equal ids each one takes its label. Without labels of both kinds there is nothing to rank: every score is the share
of good labels, 0.5 without labels. Empty tables give no rows. Columns other than id, text and label are not read.
"""

from __future__ import annotations

import math
import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.hashing import digest
from sensorloom.llm.common import portions
from sensorloom.llm.selection import kth_key
from sensorloom.operators.positions import shuffled
from sensorloom.session import keep

MATCHES = 2
PENALTY = 1e-3
ROUNDS = 25
TOLERANCE = 1e-6
CUT = 0.3
SCORE_STEPS = 1e9
_PIECE = 1 << 20

# kinds of bytes: lower case, upper case, digit, blank, line end, mark of a sentence, bracket or quote, other sign, beyond ASCII
_SETS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:!?", b"()[]{}\"'`-")
OTHER, BEYOND = len(_SETS), len(_SETS) + 1
KINDS = len(_SETS) + 2
_KIND = np.array([next((k for k, s in enumerate(_SETS) if b in s), BEYOND if b >= 128 else OTHER) for b in range(256)], np.uint8)
MEASURES = ("log_bytes", "log_words", "word_length", "richness", "repeated_next", "compressed", "lines_per_word", "repeated_lines", "longest_word")
FEATURES = KINDS * KINDS + len(MEASURES)


def _pieces(text: bytes):
    """The text in pieces that end at white space, of about _PIECE bytes."""
    start = 0
    while start < len(text):
        end = text.find(b" ", start + _PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def features(text: bytes | None) -> np.ndarray:
    """The description of one whole text."""
    text = text or b""
    x = np.zeros(FEATURES, np.float32)
    if not text:
        return x
    steps, before = np.zeros(KINDS * KINDS, np.int64), None
    words, length, longest, repeated, last, seen = 0, 0, 0, 0, None, set()
    squeezed, packer = 0, zlib.compressobj(1)
    for piece in _pieces(text):
        kinds = _KIND[np.frombuffer(piece, np.uint8)]
        steps += np.bincount(kinds[:-1].astype(np.int64) * KINDS + kinds[1:], minlength=KINDS * KINDS)
        if before is not None:
            steps[int(before) * KINDS + int(kinds[0])] += 1
        before = kinds[-1]
        squeezed += len(packer.compress(piece))
        found = piece.split()
        if found:
            sizes = list(map(len, found))
            words, length, longest = words + len(found), length + sum(sizes), max(longest, max(sizes))
            repeated += sum(map(operator.eq, found, found[1:])) + (found[0] == last)
            last = found[-1]
            seen.update(found)
    squeezed += len(packer.flush())
    lines = [line for line in text.split(b"\n") if line.strip()]
    x[: KINDS * KINDS] = np.sqrt(steps / max(1, len(text) - 1))
    x[KINDS * KINDS :] = (
        math.log1p(len(text)),
        math.log1p(words),
        math.log1p(length / max(1, words)),
        math.log1p(len(seen)) / math.log1p(max(1, words)),
        math.sqrt(repeated / max(1, words)),
        math.log1p(squeezed) - math.log1p(len(text)),
        math.sqrt(len(lines) / max(1, words)),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(longest),
    )
    return x


def _lists(values: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(0, values.size + 1, values.shape[1], np.int32) if values.size else np.zeros(1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def described(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _x) of every row, stored."""

    def run(batches):
        for batch in portions(batches, 1):
            x = np.array([features(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x)], ["_id", "_x"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return keep(source.mapInArrow(run, f"_id {kind}, _x array<float>"), "described")


def preferences(good: DataFrame, bad: DataFrame, matches: int, seed: int) -> DataFrame:
    """_d: differences of features, preferred minus other, for `matches` partners of each row of the larger class. Rows have _x, _id, _position, _rows."""
    n_good, n_bad = (rows.select(F.max("_rows")).first()[0] or 0 for rows in (good, bad))
    many, few, sign, n = (good, bad, 1, n_bad) if n_good >= n_bad else (bad, good, -1, n_good)
    partner = F.pmod(F.xxhash64("_position", "_match", F.lit(seed)), F.lit(max(1, n)))
    drawn = many.select("_position", F.col("_x").alias("_a"), F.explode(F.sequence(F.lit(1), F.lit(matches))).alias("_match")).select("_a", partner.alias("_partner"))
    met = drawn.join(few.select(F.col("_position").alias("_partner"), F.col("_x").alias("_b")), "_partner")
    return met.select(F.zip_with("_a", "_b", lambda a, b: F.lit(float(sign)).cast("float") * (a - b)).alias("_d"))


def _sums(pairs: DataFrame, weights: np.ndarray | None) -> np.ndarray:
    """Sums over all pairs: rows, loss, gradient and curvature, or rows and squares where there are no weights yet."""
    width = FEATURES

    def run(batches):
        total = 0
        for batch in batches:
            d = _matrix(batch.column(0), width)
            if weights is None:
                total = total + np.r_[len(d), (d * d).sum(0)]
                continue
            z = d @ weights
            other = 0.5 * (1 - np.tanh(0.5 * z))
            curve = (d * (other * (1 - other))[:, None]).T @ d
            total = total + np.r_[len(d), np.logaddexp(0, -z).sum(), -(other[:, None] * d).sum(0), curve.ravel()]
        if np.ndim(total):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "value"])

    found = pairs.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros(1 + width if weights is None else 2 + width + width * width)
    for row in found:
        sums[row["at"]] = row["value"]
    return sums


def fit_preferences(pairs: DataFrame, penalty: float = PENALTY) -> np.ndarray:
    """Weights that minimize the mean logistic loss of the pairs and a penalty on weights of differences of mean square 1."""
    squares = _sums(pairs, None)
    n = squares[0]
    if n == 0:
        return np.zeros(FEATURES)
    scale = np.sqrt(squares[1:] / n)
    scale[scale == 0] = np.inf
    weights, step, best = np.zeros(FEATURES), np.zeros(FEATURES), math.inf
    for _ in range(ROUNDS):
        sums = _sums(pairs, weights / scale)
        loss = sums[1] / n + 0.5 * penalty * (weights @ weights)
        if loss > best + 1e-12:
            # too far: half the way back
            step /= 2
            weights = weights - step
            continue
        best = loss
        gradient = sums[2 : 2 + FEATURES] / n / scale + penalty * weights
        if np.abs(gradient).max() < TOLERANCE:
            break
        curve = sums[2 + FEATURES :].reshape(FEATURES, FEATURES) / n / scale[:, None] / scale[None, :] + penalty * np.eye(FEATURES)
        step = -np.linalg.solve(curve, gradient)
        weights = weights + step
    return weights / scale


@dataclass(frozen=True)
class RankModel:
    """Weights of the features and the score of the threshold; without weights every row has the score `share`."""

    weights: np.ndarray | None
    threshold: float
    share: float


def _ranks(rows: DataFrame, weights: np.ndarray, name: str = "_id") -> DataFrame:
    """(name, _s): the row's own score in whole steps of 1 / SCORE_STEPS."""
    width = FEATURES

    def run(batches):
        for batch in batches:
            s = np.rint(_matrix(batch.column(1), width) @ weights * SCORE_STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], [name, "_s"])

    kind = rows.schema[name].dataType.simpleString()
    return rows.select(name, "_x").mapInArrow(run, f"{name} {kind}, _s bigint")


def fit(
    rows: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    label_id: str = "doc_id",
    learn: Column | None = None,
    matches: int = MATCHES,
    seed: int = 1,
    penalty: float = PENALTY,
) -> RankModel:
    """The model of described() rows whose label is 1 (good) or 0; learn is a condition on the labels' rows."""
    known = labels if learn is None else labels.where(learn)
    known = known.select(F.col(label_id).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna()
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    labelled = rows.join(known, "_id")
    key = digest(F.col("_id"), F.xxhash64("_x"), seed)
    good, bad = (shuffled(labelled.where(F.col("_label") == k).select("_id", "_x"), key, ["_id"], "_position", "_rows") for k in (1, 0))
    n_good, n_bad = (part.count() for part in (good, bad))
    if not n_good or not n_bad:
        return RankModel(None, 0.0, n_good / (n_good + n_bad) if n_good + n_bad else 0.5)
    weights = fit_preferences(keep(preferences(good, bad, matches, seed), "preferences"), penalty)
    scores = keep(_ranks(good.unionByName(bad), weights).select("_s"), "labelled_scores")
    below, above = kth_key(scores, n_bad - 1)[0], kth_key(scores, n_bad)[0]
    return RankModel(weights, (below + above + 1) // 2 / SCORE_STEPS, n_good / (n_good + n_bad))


def score(rows: DataFrame, model: RankModel, cut: float = CUT) -> DataFrame:
    """(_id, score): between 0 and 1, cut at the model's threshold."""
    if model.weights is None:
        return rows.select("_id", F.lit(float(model.share)).alias("score"))
    limit = round(model.threshold * SCORE_STEPS)
    z = (F.col("_s") - F.lit(limit)) / F.lit(SCORE_STEPS) + F.lit(math.log(cut / (1 - cut)))
    value = F.round(1 / (1 + F.exp(-z)), 9)
    # rounding moves no row over the threshold
    above = F.when(F.col("_s") >= F.lit(limit), F.greatest(value, F.lit(cut))).otherwise(F.least(value, F.lit(cut - 1e-9)))
    return _ranks(rows, model.weights).select("_id", above.alias("score"))
