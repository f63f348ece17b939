"""Repeated byte strings across a corpus by a distributed difference-cover suffix algorithm.

Every byte that lies in a string of `length` bytes which also starts earlier (in an earlier document, or earlier in the same one) is removed.

1. Tokens. A window of `length` bytes picks the smallest hash (by its upper 36 bits) among its grams of GRAM bytes (leftmost on ties), so equal
   windows pick the same place; the picked places cut a text into tokens. A gram that occurs once in the corpus cannot lie in a repeated window, so only tokens
   whose gram occurs twice go on. Each owns the windows that picked it.
2. Suffix names over tokens. Places 1 and 2 of every three (a difference cover modulo 3) are sampled. Three tokens from a sampled place on get a
   name, and again three names in step get one, which stands for nine tokens. Names are 128-bit fingerprints and not ranks: the question is which
   prefixes are equal, so the recursion stays inside a text and the corpus is sorted once, by the last names. In this suffix order equal prefixes
   are neighbours; every one but the first of a run occurs earlier, and the bytes its name covers are removed. Two repeats at any places have a
   shift of 0, 1 or 2 that makes both sampled, and names of nine tokens overlap, so the suffixes between are merged into the covered stretch.
3. Edges. Windows that no name covers (where a repeat begins or ends inside a token) are compared, as two 64-bit hashes, with the windows of the
   same gram and offset that no name covers either. The first occurrence of a window is never covered, so this comparison is exact, and it
   also settles what a name has missed at the border of two ranges of the sort.

Scale: text moves three times (to its tokens, to its open windows if a gram has several, to its spans), rows per token otherwise. Grams meet in
buckets, where a frequent gram counts once for each portion of texts. The sort's ranges split equal names, so a passage of a third of all documents is
spread out. A gram with more than GRAM_ROWS open tokens is compared window by window through an aggregate instead of inside one task. Each step is a
stored table, so a lost executor repeats a step's tasks only.

Cases: null and empty texts, and texts below `length` bytes, keep everything. A null id comes before all others. Rows equal in id and text
are one document with one result. Empty tables give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.llm.common import identified, portions, same_document
from sensorloom.session import keep

LENGTH = 100
GRAM = 32
GRAM_ROWS = 50_000
PIECE_ROWS = 2000
BUCKETS = 1024
_AT_ONCE = 1 << 19
_PLACE_BITS = 28
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_ODD = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407))
_DOC = ("_id", "_digest")


@functools.cache
def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(count - 1, np.uint64(base))], dtype=np.uint64)


def _power(base: np.uint64, count: int) -> np.ndarray:
    return _powers(int(base), max(1 << 20, 1 << (count - 1).bit_length()))[:count]


def _rolling(data: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash (modulo 2**64) of the `width` bytes from each place on."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    terms = np.zeros(n + 1, np.uint64)
    np.multiply(data.astype(np.uint64) + np.uint64(1), _power(base, n), out=terms[1:])
    sums = np.cumsum(terms, out=terms)
    return (sums[width:] - sums[:-width]) * _power(np.uint64(pow(int(base), -1, 1 << 64)), n - width + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    for _ in range(2):
        h *= _ODD[1]
        h ^= h >> np.uint64(32)
    return h


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each run of `width` values, from doubling spans."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _picks(values: np.ndarray, width: int, windows: np.ndarray):
    """(first window, pick, last window) of each token, for sorted windows.

    Grams are compared by the upper bits of their values and their place in the lower ones, so a window's least is its leftmost minimum and says
    where it lies, also where a gram comes again inside the window.
    """
    places = np.uint64((1 << _PLACE_BITS) - 1)
    ranks = values & ~places
    ranks |= np.arange(len(values), dtype=np.uint64)
    least = _minima(ranks, width)[windows]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (windows[1:] != windows[:-1] + 1)])
    last = windows[np.r_[new[1:], len(windows)] - 1]
    return windows[new], (least[new] & places).astype(np.int64), last


def _of_buffer(parts: list[bytes], length: int, gram: int):
    """Tokens of several pieces of text laid side by side: (piece, place, gram hash, first window, last window), places within a piece."""
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - length + 1, 0)
    windows = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
    if not len(windows):
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    hashes = _mix(_rolling(np.frombuffer(b"".join(parts), np.uint8), gram, _BASES[0]))
    first, pick, last = _picks(hashes, length - gram + 1, windows)
    piece = np.searchsorted(starts, first, "right") - 1
    # pieces without bytes start where the next one does
    at = starts[piece]
    return piece, pick - at, hashes[pick], first - at, last - at


def anchors(texts: list[bytes | None], length: int, gram: int):
    """(text, place, gram hash, first window, last window) of every token of the texts, in order."""
    parts, owner, offset, size, out = [], [], [], 0, []

    def flush():
        piece, place, hashes, first, last = _of_buffer(parts, length, gram)
        move = np.array(offset, np.int64)[piece] if len(piece) else piece
        out.append((np.array(owner, np.int64)[piece] if len(piece) else piece, place + move, hashes, first + move, last + move))

    for number, text in enumerate(texts):
        for start in range(0, len(text or b"") - length + 1, _AT_ONCE):
            parts.append(text[start : start + _AT_ONCE + length - 1])
            owner.append(number)
            offset.append(start)
            size += len(parts[-1])
            if size >= _AT_ONCE:
                flush()
                parts, owner, offset, size = [], [], [], 0
    flush()
    text, place, hashes, first, last = (np.concatenate(p) for p in zip(*out))
    # a token whose windows lie in two pieces is one
    new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])] if len(place) else np.zeros(0, bool)
    end = np.r_[np.flatnonzero(new)[1:], len(place)][: int(new.sum())] - 1
    return text[new], place[new], hashes[new], first[new], last[end]


def _document() -> Column:
    """A short name of the document; where two share it, either gets some tokens more, which does no harm."""
    return F.xxhash64(*_DOC)


def _places(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """(_doc, a) of the tokens whose gram occurs twice.

    Grams meet by buckets of their hashes, a row of packed numbers for each portion of texts and bucket. A gram that a portion holds twice is known
    to be repeated: its places need not meet any other, and it goes to its bucket once, so a frequent gram weighs no more than its portions.
    """
    buckets = max(BUCKETS, 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = ("h", "doc", "a", "again", "again_doc", "again_a")
    kinds = (np.int64, np.int64, np.int32, np.int64, np.int64, np.int32)

    def deal(batches):
        for batch in portions(batches, 1):
            text, place, hashes, _, _ = anchors(batch.column(1).to_pylist(), length, gram)
            if not len(text):
                continue
            doc, place = batch.column(0).to_numpy()[text], place.astype(np.int32)
            order = np.argsort(hashes)
            h = hashes[order]
            new = np.r_[True, h[1:] != h[:-1]]
            alone = new & np.r_[new[1:], True]
            one, first, rest = order[alone], order[new & ~alone], order[~alone]
            # sorted by hash, so the grams of a bucket lie side by side
            bounds = (np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)).astype(np.uint64)
            cuts = [np.searchsorted(hashes[x], bounds) for x in (one, first)]
            # places that are known already go along anywhere
            cuts.append(np.arange(1, buckets) * len(rest) // buckets)
            columns = []
            for x, cut, what in ((one, 0, (hashes, doc, place)), (first, 1, (hashes,)), (rest, 2, (doc, place))):
                edges = [0, *cuts[cut].tolist(), len(x)]
                for values in what:
                    data, width = values[x].tobytes(), values.itemsize
                    columns.append(pa.array([data[i * width : j * width] for i, j in zip(edges, edges[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), *columns], ["bucket", *packed])

    def meet(rows: pa.Table) -> pa.Table:
        h, doc, a, again, again_doc, again_a = (
            np.frombuffer(b"".join(rows.column(name).to_pylist()), kind) for name, kind in zip(packed, kinds)
        )
        _, which, count = np.unique(np.concatenate([h, again, again]), return_inverse=True, return_counts=True)
        taken = count[which[: len(h)]] > 1
        return pa.table({"_doc": np.concatenate([doc[taken], again_doc]), "a": np.concatenate([a[taken], again_a])})

    source = documents.select(_document().alias("_doc"), F.col("_text").cast("binary").alias("_text"))
    dealt = source.mapInArrow(deal, "bucket bigint, " + ", ".join(f"{name} binary" for name in packed))
    return dealt.groupBy("bucket").applyInArrow(meet, "_doc bigint, a int")


def _folded(name: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Names (rows of two lanes) of three names each; ahead holds the rows one and two steps on, -1 where there are none."""
    total = name * _ODD[0]
    for k in (0, 1):
        step = ahead[:, k]
        there = np.where((step >= 0)[:, None], name[step] + np.uint64(1), np.uint64(0))
        total = _mix(total + there * _ODD[k + 1] + np.uint64(k + 1))
    return total


def _steps(group: np.ndarray, t: np.ndarray, stride: int) -> np.ndarray:
    """For sorted tokens: the rows `stride` and twice `stride` places on in the same text, if all between are there; else -1."""
    at = np.arange(len(t))
    out = np.full((len(t), 2), -1)
    for k in (1, 2):
        ahead = at + k * stride
        inside = ahead < len(t)
        ahead = np.where(inside, ahead, 0)
        out[:, k - 1] = np.where(inside & (group[ahead] == group) & (t[ahead] == t + k * stride), ahead, -1)
    return out


def suffix_names(group: np.ndarray, t: np.ndarray, size: np.ndarray, symbol: np.ndarray):
    """(name, bytes) of up to nine tokens from each token on; symbol has a row of two lanes for each token."""
    one = _steps(group, t, 1)
    three, three_size = _folded(symbol, one), size + np.where(one >= 0, size[one], 0).sum(1)
    # names in step count while all tokens before them are there
    in_step = _steps(group, t, 3)
    nine = _folded(three, in_step)
    return nine, three_size + np.where(in_step >= 0, three_size[in_step], 0).sum(1)


def tokens(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """The tokens whose gram occurs twice: number t, place a, gram h, own windows lo..hi and, at sampled places, name and cover."""
    places = _places(documents, length, gram)
    lists = keep(places.groupBy("_doc").agg(F.collect_list("a").alias("places")), "places")
    source = documents.withColumn("_doc", _document()).join(lists, "_doc")
    source = source.select(*_DOC, F.col("_text").cast("binary").alias("_text"), "places")

    def run(batches):
        for batch in portions(batches, 2):
            texts = batch.column(2).to_pylist()
            text, place, hashes, first, last = anchors(texts, length, gram)
            wanted = batch.column(3)
            owner = np.repeat(np.arange(len(texts)), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            flat = wanted.flatten().to_numpy(zero_copy_only=False)
            span = np.int64(1) << np.int64(40)
            taken = np.flatnonzero(np.isin(text * span + place, owner * span + flat))
            t = np.arange(len(text)) - np.searchsorted(text, text)
            ends = np.array([len(x) for x in texts], np.int64)
            follows = np.r_[text[1:] == text[:-1], False] if len(text) else np.zeros(0, bool)
            after = np.where(follows, np.r_[place[1:], 0] if len(place) else place, ends[text] - gram)
            size = after - place
            digest = hashlib.blake2b
            symbols = b"".join(
                digest(texts[x][a : b + gram], digest_size=16).digest()
                for x, a, b in zip(text[taken].tolist(), place[taken].tolist(), after[taken].tolist())
            )
            symbol = np.frombuffer(symbols, np.uint64).reshape(-1, 2)
            name, cover = suffix_names(text[taken], t[taken], size[taken], symbol)
            cover = cover + gram
            sampled = (t[taken] % 3 != 0) & (cover >= length)
            row = pa.array(text[taken])
            columns = (t[taken], place[taken], hashes[taken].view(np.int64), first[taken], last[taken])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row),
                    batch.column(1).take(row),
                    *map(pa.array, columns),
                    *(pa.array(name[:, k].copy().view(np.int64), mask=~sampled) for k in (0, 1)),
                    pa.array(cover, mask=~sampled),
                ],
                [*_DOC, "t", "a", "h", "lo", "hi", "n1", "n2", "cover"],
            )

    kind = documents.schema["_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in ("t", "a", "h", "lo", "hi", "n1", "n2", "cover"))
    return source.mapInArrow(run, f"_id {kind}, _digest bigint, {numbers}")


def _same(column: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j are equal, nulls included."""
    a, b = column.take(pa.array(i)), column.take(pa.array(j))
    equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    return equal | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))


def _order(*columns: str) -> list:
    return [F.col(c).asc_nulls_first() for c in columns]


def covered(base: DataFrame) -> DataFrame:
    """(document, t, start, stop) of the named suffixes that occur earlier too: neighbours with equal names in suffix order."""
    named = base.filter("n1 is not null").select("n1", "n2", *_DOC, "t", "a", "cover")
    order = _order("n1", "n2", *_DOC, "t")
    kind = base.schema["_id"].dataType.simpleString()

    def compare(batches):
        head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.num_rows
            if head is not None:
                batch = pa.Table.from_batches([head, batch]).combine_chunks().to_batches()[0]
            n1, n2, _, digest, t, a, cover = (batch.column(k) if k == 2 else batch.column(k).to_numpy() for k in range(7))
            new = np.r_[True, (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            at = np.arange(len(n1))
            later = np.flatnonzero(((t != t[first]) | (digest != digest[first]) | ~_same(batch.column(2), at, first)) & (at >= len(n1) - own))
            taken = pa.array(later)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(taken), batch.column(3).take(taken), *map(pa.array, (t[later], a[later], a[later] + cover[later]))],
                [*_DOC, "t", "start", "stop"],
            )
            head = batch.slice(int(first[-1]), 1)

    number = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = named.repartitionByRange(number, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(compare, f"_id {kind}, _digest bigint, t bigint, start bigint, stop bigint")


def _open_windows(base: DataFrame, done: DataFrame, length: int) -> DataFrame:
    """Tokens with the windows from_lo..to_hi that no name covers (at least those; a covered one may be among them)."""
    order = Window.partitionBy(*_DOC).orderBy("t")
    closed = done.select(F.col("_id").alias("_c_id"), F.col("_digest").alias("_c_digest"), F.col("t").alias("_c_t"), "start", "stop")
    same = base["_id"].eqNullSafe(closed["_c_id"]) & (base["_digest"] == closed["_c_digest"]) & (base["t"] == closed["_c_t"])
    marked = base.select(*_DOC, "t", "a", "h", "lo", "hi").join(closed, same, "left")
    reach = F.when(F.col("stop").isNotNull(), F.struct((F.col("stop") - length).alias("to"), F.col("start").alias("from")))
    marked = marked.select(*_DOC, "t", "a", "h", "lo", "hi", reach.alias("_reach"))
    best = {f"_best_{k}": F.lag("_best_1", k - 1).over(order) for k in (2, 3)}
    again = F.coalesce(F.lag("t").over(order) == F.col("t"), F.lit(False))
    marked = marked.withColumn("_best_1", F.max("_reach").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.select("*", *(v.alias(k) for k, v in best.items()), again.alias("_again")).filter(~F.col("_again"))
    start = F.col("lo")
    for name in ("_best_1", *best):
        skip = F.col(name).isNotNull() & (F.col(name)["from"] <= start)
        start = F.when(skip, F.greatest(start, F.col(name)["to"] + 1)).otherwise(start)
    end = F.when(F.col("_reach").isNotNull() & (F.col("hi") == F.col("a")), F.col("hi") - 1).otherwise(F.col("hi"))
    return marked.select(*_DOC, "a", "h", start.alias("from_lo"), end.alias("to_hi")).filter("from_lo <= to_hi")


def _with_bytes(documents: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """Open tokens (crowded: whether their gram is) with the bytes of their windows."""
    lists = opened.groupBy(*_DOC).agg(F.collect_list(F.struct("a", "h", "from_lo", "to_hi", "crowded")).alias("open"))
    source = documents.join(lists, same_document(documents, lists))
    source = source.select(documents["_id"], documents["_digest"], F.col("_text").cast("binary").alias("_text"), "open")

    def run(batches):
        for batch in portions(batches, 2):
            listed = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
            flat = listed.flatten()
            a, h, lo, hi, crowded = (flat.field(k) for k in range(5))
            texts = batch.column(2).to_pylist()
            pieces = [texts[x][b : e + length] for x, b, e in zip(row.tolist(), lo.to_pylist(), hi.to_pylist())]
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), a, h, lo, hi, pa.array(pieces, pa.binary()), crowded],
                [*_DOC, "a", "h", "from_lo", "to_hi", "bytes", "crowded"],
            )

    kind = documents.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, _digest bigint, a bigint, h bigint, from_lo bigint, to_hi bigint, bytes binary, crowded boolean")


def _window_keys(a, h, from_lo, to_hi, texts: list[bytes], length: int):
    """(row, window, key, second hash) of every window of open tokens."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes) - sizes
    count = to_hi - from_lo + 1
    row = np.repeat(np.arange(len(a)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    window = step + from_lo[row]
    one, two = (_rolling(data, length, b)[base[row] + step] for b in _BASES)
    offset = (a[row] - window).astype(np.uint64)
    return row, window, _mix(one) ^ _mix(h[row].view(np.uint64) + offset * _ODD[0]), two


def _edge_spans(documents: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """(document, start, stop) of open windows that occur earlier, compared within each gram.

    Whether a gram is crowded goes along with its rows. The rows are dealt by gram straight from their table: were they joined by gram there, Spark
    would take that join's exchange for the one asked for, and may read it by its writers or split it, so that a gram's rows come apart.
    """
    number = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = keep(opened.groupBy("h").agg(F.count("*").alias("_n")).filter("_n > 1"), "open-grams")
    several = opened.join(counts.select("h", (F.col("_n") > GRAM_ROWS).alias("crowded")), "h")
    rows = keep(_with_bytes(documents, several, length), "open-bytes")
    kind = opened.schema["_id"].dataType.simpleString()

    def windows(batch):
        numbers = [batch.column(k).to_numpy() for k in range(2, 6)]
        return _window_keys(*numbers, batch.column(6).to_pylist(), length)

    def spans(batch):
        at = np.arange(1, batch.num_rows)
        digest, a = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        again = np.r_[False, (digest[1:] == digest[:-1]) & (a[1:] == a[:-1]) & _same(batch.column(0), at, at - 1)]
        batch = batch.filter(pa.array(~again))
        row, window, key, two = windows(batch)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        equal = same & (two[order[1:]] == two[order[:-1]])
        if not np.array_equal(same, equal):  # windows that differ in the second hash alone may lie between equal ones
            order = np.lexsort((two, key))
            equal = (key[order[1:]] == key[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        later = np.zeros(len(row), bool)
        later[order[1:]] = equal
        row, window = row[later], window[later]
        new = np.r_[True, (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)] if len(row) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(row)][: len(begin)] - 1
        taken = pa.array(row[begin])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(window[begin]), pa.array(window[end] + length)],
            [*_DOC, "start", "stop"],
        )

    def by_pieces(batch):
        """The spans of whole grams; so many rows at once that a task's memory doesn't follow the size of its batches."""
        h = batch.column(3).to_numpy()
        cuts = np.unique(np.r_[0, np.searchsorted(h, h[PIECE_ROWS::PIECE_ROWS], "left"), len(h)]).tolist()
        for start, stop in zip(cuts, cuts[1:]):
            yield spans(batch.slice(start, stop - start))

    def compare(batches):
        held = None
        for batch in batches:
            if held is not None and batch.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            h = batch.column(3).to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))
            held = batch.slice(cut)
            if cut:
                yield from by_pieces(batch.slice(0, cut))
        if held is not None:
            yield spans(held)

    def list_windows(batches):
        for batch in (b.slice(k, PIECE_ROWS) for b in batches for k in range(0, b.num_rows, PIECE_ROWS)):
            row, window, key, two = windows(batch)
            taken = pa.array(row)
            keys = (pa.array(window), pa.array(key.view(np.int64)), pa.array(two.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), *keys], [*_DOC, "start", "k1", "k2"]
            )

    schema = f"_id {kind}, _digest bigint, start bigint"
    alone = rows.filter(~F.col("crowded"))
    here = alone.repartition(number, "h").sortWithinPartitions(*_order("h", *_DOC, "a")).mapInArrow(compare, f"{schema}, stop bigint")
    listed = rows.filter("crowded").mapInArrow(list_windows, f"{schema}, k1 bigint, k2 bigint")
    place = F.struct(*_DOC, "start")
    first = listed.groupBy("k1", "k2").agg(F.min(place).alias("_first"))
    there = listed.join(first, ["k1", "k2"]).filter(place != F.col("_first"))
    return here.union(there.select(*_DOC, "start", (F.col("start") + length).alias("stop")))


def repeated_spans(
    docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(_id, _digest, removed): spans (start, stop) in bytes, sorted, whose union is what has occurred earlier."""
    documents = identified(docs, id_col, text_col)
    base = keep(tokens(documents, length, gram), "tokens")
    done = keep(covered(base), "covered")
    opened = keep(_open_windows(base, done, length), "open")
    spans = keep(done.select(*_DOC, "start", "stop").union(_edge_spans(documents, opened, length)), "spans")
    return spans.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("removed"))
