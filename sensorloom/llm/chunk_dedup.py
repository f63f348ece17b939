"""Repeated passages, found by content-defined chunking.

A gear hash rolls over the bytes of a text: each byte shifts the hash by one bit and adds the byte's gear value, so the hash depends on the
last 32 bytes alone. A chunk ends where the hash's low bits are zero, but not before min_bytes and not after max_bytes; after an insertion the
boundaries fall back into step. Chunks are compared by a 128-bit digest; the first occurrence of a chunk, by id and place, stays. Chunks are short, so
that a passage holds some whole ones. With min_run, runs of repeated chunks below that many bytes stay; at 0 every repeated chunk is removed.

One row per chunk (digest, id, place) is exchanged, never text. Digests are reduced on the map side first, so a chunk of a third of all
documents is one row per task; the rows of repeated chunks join their first occurrence in a join that Spark can split.

Cases: null and empty texts have no chunks. A last chunk below min_bytes is never removed. Rows equal in id and text are one document; a
null id comes before all others. Empty tables give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import bound, identified, portions
from sensorloom.session import keep

MIN_BYTES = 32
MAX_BYTES = 1024
MASK_BITS = 5
MIN_RUN = 96
_HASH_AT_ONCE = 1 << 22
_DIGEST = ("_d1", "_d2")


def _gear_table() -> np.ndarray:
    """256 values from a fixed seed, the same on every machine."""
    raw = b"".join(hashlib.sha256(b"gear %d" % b).digest()[:4] for b in range(256))
    return np.frombuffer(raw, "<u4")


GEAR = _gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the number of bytes it covers."""
    h = GEAR[data]
    covered = 1
    while covered < 32:
        older = h[:-covered] << np.uint32(covered) if len(h) > covered else h[:0]
        h = h.copy()
        h[covered:] += older
        covered *= 2
    return h


def cut_candidates(text: bytes, mask_bits: int) -> np.ndarray:
    """Ends of possible chunks. The hash is taken in pieces that overlap by the 31 bytes it remembers."""
    data = np.frombuffer(text, np.uint8)
    mask = np.uint32(((1 << mask_bits) - 1) << (32 - mask_bits))
    found = []
    for start in range(0, len(data), _HASH_AT_ONCE):
        before = max(0, start - 31)
        h = gear_hashes(data[before : start + _HASH_AT_ONCE])[start - before :]
        found.append(np.flatnonzero((h & mask) == 0) + start + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(text: bytes, min_bytes: int, max_bytes: int, mask_bits: int) -> list[int]:
    ends, last = [], 0
    for cut in cut_candidates(text, mask_bits).tolist():
        while cut - last > max_bytes:
            last += max_bytes
            ends.append(last)
        if cut - last >= min_bytes:
            ends.append(cut)
            last = cut
    while len(text) - last > max_bytes:
        last += max_bytes
        ends.append(last)
    if last < len(text):
        ends.append(len(text))
    return ends


def chunks(documents: DataFrame, min_bytes: int, max_bytes: int, mask_bits: int) -> DataFrame:
    """A row for each chunk of _id, _digest, _text: its number, span and digest."""

    def run(batches):
        for batch in portions(batches, 2):
            rows, number, start, stop, digests = [], [], [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                at = 0
                for k, end in enumerate(chunk_ends(text, min_bytes, max_bytes, mask_bits)):
                    rows.append(row)
                    number.append(k)
                    start.append(at)
                    stop.append(end)
                    digests.append(hashlib.blake2b(text[at:end], digest_size=16).digest())
                    at = end
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(taken),
                    batch.column(1).take(taken),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(stop, pa.int64()),
                    pa.array(both[:, 0].copy()),
                    pa.array(both[:, 1].copy()),
                ],
                ["_id", "_digest", "_number", "_start", "_stop", "_d1", "_d2"],
            )

    kind = documents.schema["_id"].dataType.simpleString()
    source = documents.select("_id", "_digest", F.col("_text").cast("binary").alias("_text"))
    return source.mapInArrow(run, f"_id {kind}, _digest bigint, _number int, _start bigint, _stop bigint, _d1 bigint, _d2 bigint")


def repeated_chunks(
    docs: DataFrame,
    *,
    min_bytes: int = MIN_BYTES,
    max_bytes: int = MAX_BYTES,
    mask_bits: int = MASK_BITS,
    min_run: int = MIN_RUN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(_id, _digest, removed): runs (start, stop) in bytes of chunks that occur earlier, for documents that have repeated chunks."""
    documents = identified(docs, id_col, text_col)
    every = chunks(documents, min_bytes, max_bytes, mask_bits)
    place = F.struct("_id", "_digest", "_number")
    long_enough = F.col("_stop") - F.col("_start") >= min_bytes
    seen = every.filter(long_enough).groupBy(*_DIGEST).agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    # stored, so that both sides of the join are plain exchanges, which Spark can split at a common chunk
    repeated = keep(seen.filter("_n > 1").select(*_DIGEST, "_first"), "repeated-chunks")
    later = every.filter(long_enough).join(repeated, list(_DIGEST)).filter(place != F.col("_first"))
    span = F.struct(F.col("_start").alias("start"), F.col("_stop").alias("stop"))
    found = later.groupBy("_id", "_digest").agg(F.array_sort(F.collect_set(span)).alias("removed"))
    long_runs = F.filter(_runs(F.col("removed")), lambda r: r["stop"] - r["start"] >= min_run)
    return found.select("_id", "_digest", long_runs.alias("removed"))


def _runs(spans: Column) -> Column:
    """Sorted spans with those that touch put together."""

    def joined(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["stop"] != x["start"]))
        last = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["start"] != x["stop"]))
        return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["stop"].alias("stop")))

    return bound(spans, joined)
