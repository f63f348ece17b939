"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a batch of documents inside a task. Its suffix array holds the word positions that can begin a match, sorted by the words that
follow. Every suffix of a benchmark item is binary-searched in it; the hits give the longest verbatim matches, their places in document
and item, and each document's hit words. A document lies in one shard, so nothing is shuffled.

The benchmark goes to the tasks in blocks of at most BLOCK_WORDS words of whole items, one pass over the documents for each block, so what is
sent at once does not grow with the benchmark; passes are added up per document. A position can begin a match only if it and the words after
it are words of the block, so the array leaves out other positions: this removes no match.

Words: A-Z in lower case, then runs of ASCII letters, digits and all characters beyond ASCII. A window is `window` consecutive words of an
item; an item of fewer words is one window. Cases: null and empty texts have no words and no hits; an item without words is never found;
items with equal texts are all found; a null item id is left out of the lists; rows with equal ids stay separate rows. The passes of several
blocks are added up per id and text digest, and rows equal in both are counted and given back, so the number of blocks makes no difference.
Empty tables give no rows, or rows without hits. Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 200_000
SHARD_WORDS = 2_000_000
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


PIECE_BYTES = 1 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _numbered(text: bytes | None, number: dict[bytes, int]) -> list[np.ndarray]:
    """The words' numbers (-1: none) in pieces, so that a long text's words never lie in memory together."""
    plain, start, parts = (text or b"").translate(_TABLE), 0, []
    while start < len(plain):
        end = start + PIECE_BYTES
        end = plain.find(b" ", end) if end < len(plain) else len(plain)
        end = len(plain) if end < 0 else end
        parts.append(np.array([number.get(w, -1) for w in plain[start:end].split()], np.int32))
        start = end
    return parts


def _keys(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The width words from each start as one comparable value in word order; -1 (past the end) sorts first."""
    padded = np.r_[ids, np.full(width, -1, np.int32)] + 1
    rows = padded[starts[:, None] + np.arange(width)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"V{4 * width}").ravel()


class Items:
    """A block of benchmark items, ready to be searched for: words numbered, suffixes as search keys."""

    def __init__(self, items: list[tuple], window: int):
        self.window = window
        self.ids = [item for item, _ in items]
        self.number: dict[bytes, int] = {}
        by_width: dict[int, list[tuple[int, int, list[int]]]] = {}
        for at, (_, words) in enumerate(items):
            named = [self.number.setdefault(w, len(self.number)) for w in words]
            width = min(window, len(named))
            for offset in range(len(named) - width + 1) if width else ():
                by_width.setdefault(width, []).append((at, offset, named[offset : offset + width]))
        self.searches = {}
        for width, suffixes in by_width.items():
            keys = _keys(np.concatenate([np.array(k, np.int32) for _, _, k in suffixes]), np.arange(len(suffixes)) * width, width)
            self.searches[width] = (keys, np.array([a for a, _, _ in suffixes]), np.array([o for _, o, _ in suffixes]))

    def find(self, ids: np.ndarray):
        """Matches in a shard's word numbers (-1: not a word of the block): arrays of position, width, item and offset."""
        known = np.r_[ids >= 0, False]
        stop = np.flatnonzero(~known)
        run = stop[np.searchsorted(stop, np.arange(len(ids)))] - np.arange(len(ids)) if len(ids) else np.zeros(0, np.int64)
        found = []
        for width, (keys, items, offsets) in self.searches.items():
            starts = np.flatnonzero(run >= width)
            suffixes = _keys(ids, starts, width)
            order = np.argsort(suffixes, kind="stable")
            array, starts = suffixes[order], starts[order]
            low, high = np.searchsorted(array, keys, "left"), np.searchsorted(array, keys, "right")
            count = high - low
            each = np.repeat(np.arange(len(keys)), count)
            rank = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + low[each]
            found.append((starts[rank], np.full(len(each), width), items[each], offsets[each]))
        if not found:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(part) for part in zip(*found))


def _longest(position, width, item, offset):
    """Per item: its longest verbatim match as (item, start in the document, start in the item, words)."""
    order = np.lexsort((position, position - offset, item))
    position, width, item, offset = position[order], width[order], item[order], offset[order]
    new = np.r_[True, (np.diff(item) != 0) | (np.diff(position - offset) != 0) | (np.diff(position) != 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(position)] - 1
    length = position[last] + width[last] - position[first]
    best = {}
    for k in np.argsort(-length, kind="stable"):
        best.setdefault(int(item[first[k]]), (int(position[first[k]]), int(offset[first[k]]), int(length[k])))
    return best


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Whole items in blocks of bounded size, read one partition at a time."""
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator()
    block, size = [], 0
    for item, text in rows:
        words = words_of(bytes(text) if text is not None else None)
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    yield block


_MATCHES = "array<struct<item:string,doc_start:bigint,item_start:bigint,words:bigint>>"


def _one_pass(docs: DataFrame, block: list[tuple], window: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Items(block, window))

    def shard(ids, digests, texts):
        items = shared.value
        words, bounds, parts = 0, [0], []
        for text in texts:
            named = _numbered(text, items.number)
            parts += [*named, np.array([-1], np.int32)]
            words += sum(map(len, named)) + 1
            bounds.append(words)
        position, width, item, offset = items.find(np.concatenate(parts))
        bounds = np.array(bounds)
        doc = np.searchsorted(bounds, position, "right") - 1
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(texts) + 1))
        rows = []
        for k in range(len(texts)):
            own = order[cuts[k] : cuts[k + 1]]
            n = int(bounds[k + 1] - bounds[k] - 1)
            if not len(own):
                rows.append((n, [], []))
                continue
            at = position[own] - bounds[k]
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width[own], -1)
            hit = np.r_[False, np.cumsum(edge[:-1]) > 0, False].astype(np.int8)
            turn = np.diff(hit)
            spans = [[int(a), int(b)] for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1))]
            best = _longest(at, width[own], item[own], offset[own])
            matches = [
                {"item": items.ids[i], "doc_start": a, "item_start": b, "words": c} for i, (a, b, c) in sorted(best.items())
            ]
            rows.append((n, spans, matches))
        n, spans, matches = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [
                ids,
                digests,
                pa.array(n, pa.int64()),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                pa.array(
                    matches,
                    pa.list_(
                        pa.struct(
                            [("item", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())]
                        )
                    ),
                ),
            ],
            ["_id", "_digest", "n_words", "spans", "matches"],
        )

    def run(batches):
        for batch in batches:
            start, size = 0, 0
            texts = batch.column(2).to_pylist()
            for k, text in enumerate(texts):
                size += len(text or b"")
                if size > 6 * SHARD_WORDS or k == len(texts) - 1:
                    ids, digests = (batch.column(c).slice(start, k + 1 - start) for c in (0, 1))
                    yield shard(ids, digests, texts[start : k + 1])
                    start, size = k + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("binary")
    digest = F.xxhash64(F.coalesce(text, F.lit(b"")))
    source = docs.select(F.col(id_col).alias("_id"), digest.alias("_digest"), text.alias("_text"))
    return source.mapInArrow(run, f"_id {kind}, _digest bigint, n_words bigint, spans array<array<bigint>>, matches {_MATCHES}")


def _runs(spans: Column) -> Column:
    """[start, end) spans in order, with those that overlap or touch put together."""
    state = F.aggregate(
        F.array_sort(spans),
        F.lit(None).cast("struct<done:array<array<bigint>>,last:array<bigint>>"),
        lambda s, x: F.when(s.isNull(), F.struct(F.array().cast("array<array<bigint>>").alias("done"), x.alias("last")))
        .when(x[0] <= s["last"][1], F.struct(s["done"].alias("done"), F.array(s["last"][0], F.greatest(s["last"][1], x[1])).alias("last")))
        .otherwise(F.struct(F.concat(s["done"], F.array(s["last"])).alias("done"), x.alias("last"))),
        lambda s: F.when(s.isNull(), F.array().cast("array<array<bigint>>")).otherwise(F.concat(s["done"], F.array(s["last"]))),
    )
    return state


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Each document's id, n_words, spans (hit words as [start, end) pairs) and matches (the longest one for each item found)."""
    passes = [_one_pass(docs, block, window, id_col, text_col) for block in _blocks(benchmark, item_col, item_text_col)]
    if len(passes) == 1:
        return passes[0].drop("_digest").withColumnRenamed("_id", id_col)
    every = functools.reduce(DataFrame.unionByName, (p.withColumn("_pass", F.lit(k)) for k, p in enumerate(passes)))
    # rows equal in id and text have equal results in a pass: one of them, and how many there are
    each = every.groupBy("_id", "_digest", "_pass").agg(
        F.count("*").alias("_copies"), *(F.first(c).alias(c) for c in ("n_words", "spans", "matches"))
    )
    found = F.array_sort(F.collect_list(F.struct("_pass", "spans", "matches")))
    both = each.groupBy("_id", "_digest").agg(F.max("_copies").alias("_copies"), F.max("n_words").alias("n_words"), found.alias("_found"))
    copies = both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copies.select(
        F.col("_id").alias(id_col),
        "n_words",
        _runs(F.flatten("_found.spans")).alias("spans"),
        F.flatten("_found.matches").alias("matches"),
    )


def hit_words(spans):
    """Number of words in the union of [start, end) spans, as a column expression."""
    start = F.lit(0).cast("bigint")
    state = F.aggregate(
        F.array_sort(spans),
        F.struct(start.alias("n"), start.alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x[1] - F.greatest(x[0], s["end"]))).alias("n"), F.greatest(s["end"], x[1]).alias("end")
        ),
    )
    return state["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """matches() with n_hit, n_items, items (sorted as strings) and contaminated."""
    found = matches(docs, benchmark, **options)
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda i: i.isNotNull())))
    return (
        found.withColumn("n_hit", hit_words(F.col("spans")))
        .withColumn("items", items)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )
