"""The k-th smallest key of a table by weighted medians of medians, so that no task and no driver sees all keys.

In a round every task splits the keys still open at a pivot, in portions of at most PORTION keys, and returns for each portion how many lie on either side and
the median of each side. The weighted median of these medians (weights: the keys each one stands for) is the next pivot: at least a quarter of the open
keys lies on either side of it, so whichever side does not hold the k-th key is discarded, a quarter of all at least and half of them when portions are alike.
The open keys are an interval, so nothing but its two ends is sent out; the table is written anew when a sixteenth of its rows is left, and
the last FINISH keys are sorted where the medians meet.

Cases: keys are rows of integers compared from left to right, no nulls; equal keys are allowed. k must lie below the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.session import keep

PORTION = 1 << 20
FINISH = 10_000
SHRINK = 16
Key = tuple[int, ...]


def _side(keys: np.ndarray, pivot: Key) -> np.ndarray:
    """-1, 0 or 1 for keys below, at or above the pivot."""
    side = np.zeros(len(keys), np.int8)
    for values, at in zip(keys.T, pivot):
        side = np.where(side == 0, (values > at).astype(np.int8) - (values < at), side)
    return side


def _nth(keys: np.ndarray, n: int) -> Key:
    """The n-th smallest row, column after column."""
    found = []
    for column in range(keys.shape[1]):
        values = keys[:, column]
        value = np.partition(values, n)[n]
        n -= int(np.count_nonzero(values < value))
        keys = keys[values == value]
        found.append(int(value))
    return tuple(found)


def _median(keys: np.ndarray) -> list[int] | None:
    return list(_nth(keys, (len(keys) - 1) // 2)) if len(keys) else None


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The least median such that it and the smaller ones stand for half of the keys."""
    total, seen = sum(weight for _, weight in medians), 0
    for key, weight in sorted(medians):
        seen += weight
        if 2 * seen >= total:
            return key
    raise ValueError("no keys")


def _between(keys: np.ndarray, low: Key | None, high: Key | None) -> np.ndarray:
    if low is not None:
        keys = keys[_side(keys, low) > 0]
    if high is not None:
        keys = keys[_side(keys, high) < 0]
    return keys


def _open(stored: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    """Rows whose first column lies in the interval; the rest of the key is compared in the tasks."""
    first = F.col(stored.columns[0])
    if low is not None:
        stored = stored.where(first >= low[0])
    if high is not None:
        stored = stored.where(first <= high[0])
    return stored


def _arrays(batches):
    """Keys as arrays of at most about PORTION rows."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            rows += batch.num_rows
        if rows >= PORTION:
            yield np.concatenate(held)
            held, rows = [], 0
    if held:
        yield np.concatenate(held)


def _split(stored: DataFrame, low: Key | None, high: Key | None, pivot: Key | None):
    """A row per portion: keys below and above the pivot with the median of each side, and keys at the pivot; without a pivot all are above."""

    def run(batches):
        for keys in _arrays(batches):
            keys = _between(keys, low, high)
            side = np.ones(len(keys), np.int8) if pivot is None else _side(keys, pivot)
            below, above = keys[side < 0], keys[side > 0]
            row = (len(below), _median(below), int(np.count_nonzero(side == 0)), len(above), _median(above))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ["below", "below_median", "equal", "above", "above_median"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    schema = "below bigint, below_median array<bigint>, equal bigint, above bigint, above_median array<bigint>"
    return _open(stored, low, high).mapInArrow(run, schema).collect()


def kth_key(stored: DataFrame, k: int, *, finish: int = FINISH) -> Key:
    """The k-th smallest row (counted from 0) of a stored table of integer columns; finish bounds what is sorted on the driver."""

    def medians(rows, side):
        return [(tuple(r[f"{side}_median"]), r[side]) for r in rows if r[side]]

    low = high = None
    rows = _split(stored, low, high, None)
    held = left = sum(r["above"] for r in rows)
    if not 0 <= k < left:
        raise ValueError(f"no key number {k} among {left}")
    candidates = medians(rows, "above")
    while left > finish:
        pivot = weighted_median(candidates)
        rows = _split(stored, low, high, pivot)
        below, equal = sum(r["below"] for r in rows), sum(r["equal"] for r in rows)
        if k < below:
            high, left, candidates = pivot, below, medians(rows, "below")
        elif k < below + equal:
            return pivot
        else:
            low, k, left, candidates = pivot, k - below - equal, left - below - equal, medians(rows, "above")
        if left * SHRINK <= held and left > finish:
            stored, held = keep(_open(stored, low, high), "open_keys"), left
    last = _open(stored, low, high)
    ends = F.struct(*(F.col(c) for c in last.columns))
    for end, inside in ((low, lambda at: ends > at), (high, lambda at: ends < at)):
        if end is not None:
            last = last.where(inside(F.struct(*(F.lit(v).cast("long").alias(c) for v, c in zip(end, last.columns)))))
    return sorted(tuple(r) for r in last.collect())[k]
