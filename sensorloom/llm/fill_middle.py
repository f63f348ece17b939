"""Fill-in-the-middle: texts cut at two token boundaries and put in a new order, with marks for the three parts.

The boundaries of a text's tokens are a set of byte offsets, held the way Roaring sets hold them: one container for each 65 536 offsets, which is an array
(its offsets, at most 4 096 of them), a bitmap (one bit an offset) or a list of runs, whichever is smallest, and the containers' cumulative
cardinalities. The offset after k tokens is the set's k-th member: a binary search of the cumulative cardinalities finds the container, a select inside it
the member. A text of any length so costs its own bytes, at most 8 KB of set for each 64 KB of text, and two searches. Rows never meet: there is no shuffle.

A token is a run of letters A-Z, a-z, or one code point of any other kind. Cuts and forms depend on the seed and the row's id alone, so they are equal on
retries and under any partitioning.

Cases: null and empty texts have no tokens and are plain. Texts that hold a mark are plain, so every output can be read back. Rows with equal ids get the same
draws, each its own cuts. A null id is drawn as an empty one. Empty tables give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import portions

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
CONTAINER = 1 << 16
# an array of more members is larger than a bitmap
ARRAY_MEMBERS = 4096

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# bytes at which a code point begins
_FIRST = (np.arange(256) & 0xC0) != 0x80


class ArrayContainer:
    """Members in order, two bytes each."""

    def __init__(self, members: np.ndarray):
        self.members = members.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.members[k])


class BitmapContainer:
    """One bit for each offset, eight to a byte."""

    def __init__(self, members: np.ndarray):
        bits = np.zeros(CONTAINER, bool)
        bits[members] = True
        self.bits = np.packbits(bits)

    def select(self, k: int) -> int:
        before = np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)
        byte = int(np.searchsorted(before, k, "right"))
        inside = np.flatnonzero(np.unpackbits(self.bits[byte : byte + 1]))
        return 8 * byte + int(inside[k - (int(before[byte - 1]) if byte else 0)])


class RunContainer:
    """First members of runs, and the members in front of each."""

    def __init__(self, starts: np.ndarray, before: np.ndarray):
        self.starts, self.before = starts.astype(np.uint16), before.astype(np.uint16)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(members: np.ndarray):
    """The smallest container of sorted distinct members below CONTAINER."""
    first = np.flatnonzero(np.r_[True, members[1:] != members[:-1] + 1]) if len(members) else np.zeros(0, np.int64)
    best = min(2 * len(members), CONTAINER // 8)
    if 4 * len(first) < best:
        return RunContainer(members[first], first)
    return ArrayContainer(members) if len(members) <= ARRAY_MEMBERS else BitmapContainer(members)


class BoundarySet:
    """A sorted set of offsets given as one array of members for each range of CONTAINER offsets."""

    def __init__(self, ranges):
        kept = [(number, members) for number, members in enumerate(ranges) if len(members)]
        self.keys = [number for number, _ in kept]
        self.containers = [container(members) for _, members in kept]
        self.cumulative = np.cumsum([len(members) for _, members in kept], dtype=np.int64)

    def __len__(self) -> int:
        return int(self.cumulative[-1]) if len(self.cumulative) else 0

    def select(self, k: int) -> int:
        """The k-th member, counted from 0."""
        at = int(np.searchsorted(self.cumulative, k, "right"))
        before = int(self.cumulative[at - 1]) if at else 0
        return CONTAINER * self.keys[at] + self.containers[at].select(k - before)


def token_ends(text: bytes) -> BoundarySet:
    """Offsets of a text in UTF-8 at which a token ends, and 0; its k-th member is where k tokens end."""
    size = len(text)

    def ranges():
        raw = np.frombuffer(text, np.uint8)
        for low in range(0, size + 1, CONTAINER):
            # offset i is a boundary if a code point begins there that does not go on a run of letters
            here = raw[low : low + CONTAINER]
            letters = _LETTER[here]
            ahead = np.empty(len(here), bool)
            if len(here):
                ahead[1:] = letters[:-1]
                ahead[0] = low > 0 and _LETTER[raw[low - 1]]
            found = np.flatnonzero(_FIRST[here] & ~(letters & ahead))
            yield np.append(found, size - low) if size - low < CONTAINER else found

    return BoundarySet(ranges())


def code_points(text: bytes) -> int:
    return int(np.count_nonzero(_FIRST[np.frombuffer(text, np.uint8)]))


@dataclass(frozen=True)
class Rates:
    """Shares in percent: of texts that stay plain, and of the others those whose suffix comes first."""

    plain: int = 10
    suffix_first: int = 20


def draws(id_col: str, seed: int) -> Column:
    """Four numbers of 32 bits from the digest of seed and id."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def transformed(text: bytes, h: list[int], rates: Rates) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of prefix and of middle, output)."""
    ends = token_ends(text)
    n = len(ends) - 1
    marked = any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or h[2] % 100 >= 100 - rates.plain:
        return n, PLAIN, None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = ends.select(low), ends.select(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    first, last, behind = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h[3] % 100 < rates.suffix_first:
        form, output = SPM, b"".join((last, suffix, first, prefix, behind, middle))
    else:
        form, output = PSM, b"".join((first, prefix, last, suffix, behind, middle))
    return n, form, code_points(prefix), code_points(middle), output


def fill_middle(docs: DataFrame, *, seed: int = 1, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output."""

    def run(batches):
        for batch in portions(batches, 1):
            rows = [transformed(text, h, rates) for text, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    source = docs.select(F.col(id_col), text.alias("_text"), draws(id_col, seed).alias("_draws"))
    kind = docs.schema[id_col].dataType.simpleString()
    done = source.mapInArrow(run, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return done.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of. Outputs that are not plain hold each mark once, at the head or between two parts."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == PSM, F.concat(parts[1], parts[3], parts[2]))
        .when(form == SPM, F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
