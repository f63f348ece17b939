"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w . x - t_k): one weight vector is shared by all grades, and the thresholds t_0 < t_1 < ... are ordered. x marks which
words and word beginnings (for inflected and compound forms) of the model's vocabulary a text holds, wherever they stand; how long the text is
does not matter. The score is the expected grade,
the sum of P(grade > k) over k.

Fitting reads a bounded sample: at most SAMPLE_ROWS labelled rows, those with the smallest hash of their id (of rows with equal ids, of their words). Word statistics of the sample are
summed up in Spark; the vocabulary is the VOCABULARY words with the largest likelihood ratio between graded and clean rows, so what comes to the driver (rows
by vocabulary, bounded by these parameters) does not grow with the corpus. Scoring is a pass over all rows without a shuffle.

Cases: null and empty texts have no words and get the grade of the thresholds alone. Labels that are null or name no document are left out; of
several labels of an id the highest counts. Without labels, or with one grade only, every expected grade is that grade (0 without labels). Rows
with equal ids are scored separately. Empty tables give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.session import keep

SAMPLE_ROWS = 10_000
VOCABULARY = 256
MIN_ROWS_OF_WORD = 5
PENALTY = 0.05
# words this share of whose rows are graded above 0 mark a text; a toxic text with this many of them has the higher grade
MARKER_SHARE = 0.8
MARKERS_OF_SEVERE = 3
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 20
# lengths in bytes of the word beginnings that are features besides whole words
BEGINNINGS = (5, 6, 7, 8)


def words(text: bytes | None) -> set[bytes]:
    """Distinct words (runs of letters, A-Z in lower case), gathered piece by piece."""
    plain, start, found = (text or b"").translate(_TABLE), 0, set()
    while start < len(plain):
        end = plain.find(b" ", start + _PIECE) if start + _PIECE < len(plain) else -1
        end = len(plain) if end < 0 else end
        found.update(plain[start:end].split())
        start = end
    return found


def features(text: bytes | None) -> set[bytes]:
    """The distinct words of a text, and the beginnings of longer words with a star."""
    found = words(text)
    return found.union(*({w[:n] + b"*" for w in found if len(w) > n} for n in BEGINNINGS))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature (its bytes as Latin-1, so that every name is a string) and the ordered thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def _loss(parameters, x, grade, top, penalty):
    """Penalized negative log likelihood per row and its gradient; thresholds are a first value and the logs of the steps."""
    w, first, steps = parameters[: x.shape[1]], parameters[x.shape[1]], np.exp(parameters[x.shape[1] + 1 :])
    limits = np.r_[-np.inf, first + np.r_[0.0, np.cumsum(steps)], np.inf]
    z = x @ w
    upper, lower = _sigmoid(limits[grade + 1] - z), _sigmoid(limits[grade] - z)
    p = np.maximum(upper - lower, 1e-12)
    up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
    n = len(grade)
    limit_gradient = np.zeros(top + 2)
    np.add.at(limit_gradient, grade + 1, -up)
    np.add.at(limit_gradient, grade, low)
    inner = limit_gradient[1:-1]
    tail = np.cumsum(inner[::-1])[::-1]
    gradient = np.r_[x.T @ (up - low) / n + penalty * w / len(w), tail[0] / n, tail[1:] * steps / n]
    return -np.log(p).mean() + 0.5 * penalty * (w @ w) / len(w), gradient


def minimize(function, start, rounds: int = 200, memory: int = 10, tolerance: float = 1e-6):
    """Limited-memory quasi-Newton descent with halved steps."""
    x, (value, gradient), pairs = start, function(start), []
    for _ in range(rounds):
        if np.abs(gradient).max() < tolerance:
            break
        q, used = gradient.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            q -= a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(used)):
            q += s * (a - (y @ q) / (y @ s))
        step = 1.0 if pairs else 1.0 / max(1.0, np.abs(gradient).sum())
        while step > 1e-10:
            new = x - step * q
            new_value, new_gradient = function(new)
            if new_value <= value - 1e-4 * step * (q @ gradient):
                break
            step /= 2
        else:
            break
        s, y = new - x, new_gradient - gradient
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        x, value, gradient = new, new_value, new_gradient
    return x


def fit_ordinal(x: np.ndarray, grade: np.ndarray, names: list[str], penalty: float = PENALTY) -> OrdinalModel:
    """The model of a bounded sample: x is rows by words (0 or 1), grade 0, 1, ... without holes."""
    top = int(grade.max()) if len(grade) else 0
    if top == 0:
        return OrdinalModel({}, ())
    above = np.array([(grade > k).mean() for k in range(top)])
    limits = np.maximum.accumulate(-np.log(np.clip(above, 1e-3, 1 - 1e-3) / (1 - np.clip(above, 1e-3, 1 - 1e-3))) + 1e-3 * np.arange(top))
    start = np.r_[np.zeros(x.shape[1]), limits[0], np.log(np.maximum(np.diff(limits), 1e-3))]
    best = minimize(lambda v: _loss(v, x, grade, top, penalty), start)
    weights = best[: x.shape[1]]
    thresholds = best[x.shape[1]] + np.r_[0.0, np.cumsum(np.exp(best[x.shape[1] + 1 :]))]
    return OrdinalModel({n: float(w) for n, w in zip(names, weights)}, tuple(map(float, thresholds)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, grade_col: str) -> DataFrame:
    """(_id, _grade, _words) of at most `rows` labelled documents."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("_grade")).dropna()
    # labels that name no document take no place in the sample
    known = usable.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    chosen = known.groupBy("_id").agg(F.max("_grade").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # at most `rows` short rows
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    joined = texts.join(F.broadcast(chosen), "_id").select("_id", "_grade", "_text")

    def run(batches):
        for batch in batches:
            found = [[w.decode("latin-1") for w in sorted(features(t))] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["_id", "_grade", "_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = joined.mapInArrow(run, f"_id {kind}, _grade int, _words array<string>")
    # an id may have many rows
    return found.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_words")).limit(rows)


def _vocabulary(sample: DataFrame, size: int):
    """(word, share of its rows graded above 0) for the words that tell graded from clean rows best."""
    toxic = (F.col("_grade") > 0).cast("int")
    n, t = sample.agg(F.count("*"), F.sum(toxic)).first()
    if not t or t == n:
        return []
    counts = sample.select(toxic.alias("_t"), F.explode("_words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("_t").alias("t"))

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, b = F.col("t"), F.col("n") - F.col("t")
    ratio = (
        term(a, F.col("n") * t / n)
        + term(b, F.col("n") * (n - t) / n)
        + term(F.lit(t) - a, (F.lit(n) - F.col("n")) * t / n)
        + term(F.lit(n - t) - b, (F.lit(n) - F.col("n")) * (n - t) / n)
    )
    best = counts.filter(F.col("n") >= MIN_ROWS_OF_WORD).orderBy(ratio.desc(), "word").limit(size)
    return [(r["word"], r["t"] / r["n"]) for r in best.collect()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    grade_col: str = "toxic",
    graded_by_markers: bool = True,
    rows: int = SAMPLE_ROWS,
    size: int = VOCABULARY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> OrdinalModel:
    """A model of the labels' grades.

    graded_by_markers: labels that only say 0 or 1 become three grades; a toxic text with several different marker words gets grade 2.
    """
    sample = keep(labelled_sample(docs, labels, rows, id_col, text_col, grade_col), "labelled")
    chosen = _vocabulary(sample, size)
    names = [w for w, _ in chosen]
    if not names:
        return OrdinalModel({}, ())
    markers = {w for w, share in chosen if share >= MARKER_SHARE}
    found = sample.select("_grade", F.array_intersect("_words", F.array(*map(F.lit, names))).alias("_words")).collect()
    column = {w: k for k, w in enumerate(names)}
    x, grade = np.zeros((len(found), len(names))), np.zeros(len(found), np.int64)
    for k, row in enumerate(found):
        x[k, [column[w] for w in row["_words"]]] = 1
        severe = graded_by_markers and len(markers.intersection(row["_words"])) >= MARKERS_OF_SEVERE
        grade[k] = min(row["_grade"], 1) + severe if graded_by_markers and row["_grade"] > 0 else row["_grade"]
    return fit_ordinal(x, np.unique(grade, return_inverse=True)[1], names)


def score(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, expected_severity, grade (the most probable side of each threshold), p_toxic and toxic."""
    weights = {w.encode("latin-1"): v for w, v in model.weights.items()}
    limits = np.array(model.thresholds)
    vocabulary = weights.keys()

    def run(batches):
        for batch in batches:
            z = np.array([sum(weights[w] for w in sorted(features(t) & vocabulary)) for t in batch.column(1).to_pylist()], float)
            above = _sigmoid(z[:, None] - limits[None, :])
            p = above[:, 0] if len(limits) else np.zeros(len(z))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32)), pa.array(p), pa.array(p >= 0.5)],
                [id_col, "expected_severity", "grade", "p_toxic", "toxic"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, expected_severity double, grade int, p_toxic double, toxic boolean")
