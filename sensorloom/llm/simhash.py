"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; bit i is set if more than half of the text's shingles have it set in their hash. Two fingerprints that differ
in at most `bits` bits differ in at most one bit of one of bits // 2 + 1 blocks. The anchors of a block are the code words of a Hamming
code: every value lies within its covering radius, 1, of exactly one of them (its home). A fingerprint is replicated to all anchors
within radius plus threshold, 1 + 1, so of two close fingerprints the second one comes to the first one's home, where they are compared
on all 64 bits.

Equal fingerprints are one row before anything is compared. A task returns a spanning forest of the links it finds, never all pairs of a
dense group, and an anchor with very many members is compared in pairs of blocks of members. Components come from alternating stars.

Cases: a null or empty text has fingerprint zero, which links like any other; a text of fewer words than a shingle is one shingle. Rows
with equal ids and texts stay separate rows with equal results. A null id belongs to its component, whose id is the smallest one that is
not null. Empty tables give empty results. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import portions
from sensorloom.llm.components import components
from sensorloom.session import keep

SEED = 42
PIECE_BYTES = 1 << 20
# members of an anchor that one task compares with each other
ANCHOR_MEMBERS = 8192
_COMPARED_AT_ONCE = 1 << 20
_SMALL_GROUP = 24
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_MEMBER, _HOME, _BOTH = 0, 1, 2


def _pieces(text: bytes):
    """The words of a text in lists that stay small however long it is."""
    start = 0
    while start < len(text):
        end = start + PIECE_BYTES
        if end < len(text):
            found = _BLANK.search(text, end)
            end = found.start() if found else len(text)
        yield text[start:end].split()
        start = end


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(text: bytes | None, width: int) -> np.ndarray:
    """SimHash of a text's word shingles, as an array of one number."""
    ones, total, carried = np.zeros(64, np.int64), 0, []
    for words in _pieces((text or b"").lower()):
        words = carried + words
        if len(words) >= width:
            hashes = _hashes(words, width)
            ones += np.unpackbits(hashes[:, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(hashes)
            words = words[len(words) - width + 1 :]
        carried = words
    if not total and carried:
        return _hashes(carried, width)
    return np.packbits(2 * ones > total, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, width: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, fp) for every row: fingerprints as signed longs."""

    def run(batches):
        for batch in portions(batches, 1):
            found = [fingerprint(text, width) for text in batch.column(1).to_pylist()]
            prints = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return source.mapInArrow(run, f"_id {kind}, fp bigint")


class AnchorCode:
    """Hamming code words as the anchors of each block of a 64-bit fingerprint."""

    def __init__(self, bits: int):
        self.blocks = bits // 2 + 1
        edges = [round(64 * i / self.blocks) for i in range(self.blocks + 1)]
        self.spans = list(zip(edges, edges[1:]))
        self.checks = round(math.log2(64 / self.blocks + 1))
        self.length = (1 << self.checks) - 1

    def _syndrome(self, value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(value), np.int64)
        for k in range(self.checks):
            mask = sum(1 << (p - 1) for p in range(1, self.length + 1) if p >> k & 1)
            out |= (np.bitwise_count(value & np.uint64(mask)).astype(np.int64) & 1) << k
        return out

    def replicate(self, fp: np.ndarray):
        """(anchor, index into fp, whether the anchor is its home) for all anchors within radius plus threshold."""
        anchors, index, home = [], [], []
        for number, (low, high) in enumerate(self.spans):
            width = min(high - low, self.length)
            value = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
            syndrome = self._syndrome(value)
            nearest = np.where(syndrome > 0, value ^ (np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64)), value)
            tag = np.int64(number << self.length)
            anchors.append(nearest.astype(np.int64) | tag)
            index.append(np.arange(len(fp)))
            home.append(np.ones(len(fp), bool))
            for position in range(1, self.length + 1):
                other = syndrome ^ position
                at = np.flatnonzero((syndrome > 0) & (other > position))
                flips = np.uint64(1 << (position - 1)) | (np.uint64(1) << (other[at] - 1).astype(np.uint64))
                anchors.append((value[at] ^ flips).astype(np.int64) | tag)
                index.append(at)
                home.append(np.zeros(len(at), bool))
        return np.concatenate(anchors), np.concatenate(index), np.concatenate(home)


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j, pair by pair; parent points to each set's smallest index."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent[:] = jumped


def _linked(group, fp, role, bits: int):
    """All links within groups (sorted by group), part by part: arrays of two places."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    size_of = np.repeat(sizes, sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(group)) - 1
    at = np.flatnonzero((size_of <= _SMALL_GROUP) & (left > 0))
    for step in range(1, _SMALL_GROUP):
        at = at[left[at] >= step]
        if not len(at):
            break
        compared = ((role[at] >= _HOME) & (role[at + step] != _HOME)) | ((role[at + step] >= _HOME) & (role[at] != _HOME))
        i = at[compared]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= bits]
        yield i, i + step
    for start, size in zip(starts[sizes > _SMALL_GROUP], sizes[sizes > _SMALL_GROUP]):
        here = np.arange(start, start + size)
        homes, members = here[role[here] >= _HOME], here[role[here] != _HOME]
        step = max(1, _COMPARED_AT_ONCE // max(1, len(members)))
        for k in range(0, len(homes), step):
            part = homes[k : k + step]
            i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[members][None, :]) <= bits)
            yield part[i], members[j]


def forest(group, fp, role, bits: int):
    """Links within groups (sorted by group) as a spanning forest: places and the places of their roots."""
    parent = np.arange(len(fp))
    for i, j in _linked(group, fp, role, bits):
        _merge(parent, i, j)
    linked = np.flatnonzero(parent != np.arange(len(fp)))
    return linked, parent[linked]


def links(distinct: DataFrame, bits: int) -> DataFrame:
    """Edges (a, b) between the fingerprints fp whose components are those of all pairs that link."""
    spark = distinct.sparkSession
    code = AnchorCode(bits)

    def replicate(batches):
        for batch in batches:
            anchor, index, home = code.replicate(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), batch.column(0).take(pa.array(index)), pa.array(home)], ["anchor", "fp", "home"])

    replicated = distinct.select("fp").mapInArrow(replicate, "anchor bigint, fp bigint, home boolean")
    members = keep(replicated, "anchors")
    crowded = members.groupBy("anchor").count().filter(F.col("count") > ANCHOR_MEMBERS)
    crowded = crowded.select("anchor", F.ceil(F.col("count") / ANCHOR_MEMBERS).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    place = "array<struct<home_part:int,member_part:int,role:int>>"
    as_home = F.transform(others, lambda p: F.struct(own.alias("home_part"), p.alias("member_part"), F.lit(_HOME).alias("role")))
    as_member = F.transform(others, lambda p: F.struct(p.alias("home_part"), own.alias("member_part"), F.lit(_MEMBER).alias("role")))
    whole = F.array(F.struct(F.lit(0), F.lit(0), F.when(F.col("home"), _BOTH).otherwise(_MEMBER)))
    places = (
        F.when(F.col("parts").isNull(), whole.cast(place))
        .when(F.col("home"), F.concat(as_home, as_member).cast(place))
        .otherwise(as_member.cast(place))
    )
    placed = members.join(crowded, "anchor", "left").select("anchor", "fp", F.explode(places).alias("p"))
    placed = placed.select("anchor", "p.home_part", "p.member_part", "p.role", "fp")
    keys = ["anchor", "home_part", "member_part"]
    dealt = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)

    def compare(batches):
        held = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = [np.concatenate(pair) for pair in zip(held, columns)] if held else columns
            if not len(columns[0]):
                continue
            last = np.ones(len(columns[0]), bool)
            for k in (0, 1, 2):
                last &= columns[k] == columns[k][-1]
            held = [c[last] for c in columns]
            yield compared([c[~last] for c in columns])
        if held:
            yield compared(held)

    def compared(columns):
        anchor, home_part, member_part, role, fp = columns
        change = (anchor[1:] != anchor[:-1]) | (home_part[1:] != home_part[:-1]) | (member_part[1:] != member_part[:-1])
        a = b = np.zeros(0, np.int64)
        if len(fp):
            group = np.cumsum(np.r_[0, change])
            a, b = forest(group, fp.view(np.uint64), role, bits)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, *, width: int = 5, bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each row's id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable by links."""
    marked = keep(fingerprints(docs, width, id_col=id_col, text_col=text_col), "fingerprints")
    first = marked.groupBy("fp").agg(F.min("_id").alias("least"))
    roots = components(links(first, bits))
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
