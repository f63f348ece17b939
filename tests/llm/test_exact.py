"""Operators whose result is fully defined, against plain versions on the odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sensorloom.llm import chunk_dedup, decontaminate, line_dedup, quality, simhash, suffix_dedup
from sensorloom.llm.common import identified, without_spans
from tests.llm.frames import collected, documents, odd_rows, passage

BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def distinct_rows():
    """Rows equal in id and text (null as empty) are one document."""
    return sorted({(i is not None, i or 0, t or "") for i, t in odd_rows()})


# line dedup


def plain_lines(min_documents, keep_first):
    keys, first = {}, {}
    order = sorted(distinct_rows(), key=lambda r: (r[0], r[1], np.int64(np.uint64(xxhash.xxh64_intdigest(r[2].encode(), 42)))))
    for row in order:
        for pos, line in enumerate(row[2].split("\n")):
            key = lower(line).strip(BLANK)
            if key:
                keys.setdefault(key, set()).add(row)
                first.setdefault(key, (row, pos))
    out = []
    for known, number, text in ((i is not None, i or 0, t or "") for i, t in odd_rows()):
        row, kept = (known, number, text), []
        lines = text.split("\n")
        for pos, line in enumerate(lines):
            key = lower(line).strip(BLANK)
            dropped = key and len(keys[key]) >= min_documents and not (keep_first and first[key] == (row, pos))
            kept += [] if dropped else [line]
        out.append((number if known else None, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("min_documents", "drop"), [(10, line_dedup.DROP_ALL), (2, line_dedup.DROP_ALL), (2, line_dedup.DROP_REPEATS)])
def test_line_dedup(spark, min_documents, drop):
    docs = documents(spark)
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_documents=min_documents, drop=drop))
    assert collected(got) == plain_lines(min_documents, drop == line_dedup.DROP_REPEATS)


def test_line_dedup_of_nothing(spark):
    docs = documents(spark, [])
    assert collected(line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))) == []


# simhash


def plain_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_fingerprints_in_pieces(monkeypatch):
    text = passage(9, 700)
    whole = int(simhash.fingerprint(text.encode(), 3)[0])
    monkeypatch.setattr(simhash, "PIECE_BYTES", 50)
    assert int(simhash.fingerprint(text.encode(), 3)[0]) == whole == plain_fingerprint(text, 3)


@pytest.mark.parametrize(("width", "bits"), [(3, 3), (5, 9)])
def test_near_duplicates(spark, width, bits):
    rows = odd_rows()
    prints = {t: plain_fingerprint(t, width) for _, t in rows}
    roots = plain_components(set(prints.values()), bits)
    least = {}
    for i, t in rows:
        if i is not None:
            r = roots[prints[t]]
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, f"{prints[t]:016x}", least.get(roots[prints[t]])) for i, t in rows), key=repr)
    assert collected(simhash.near_duplicates(documents(spark), width=width, bits=bits)) == want


def test_near_duplicates_of_nothing(spark):
    assert collected(simhash.near_duplicates(documents(spark, []))) == []


@pytest.mark.parametrize("bits", [0, 1, 3, 5, 9])
def test_anchor_covering_loses_no_link(bits):
    draw = np.random.default_rng(bits)
    fp = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    for k in range(1, 300, 2):
        flips = draw.choice(64, int(draw.integers(0, bits + 1)), replace=False)
        fp[k] = fp[k - 1] ^ np.uint64(sum(1 << int(b) for b in flips))
    anchor, index, home = simhash.AnchorCode(bits).replicate(fp)
    at_home = {}
    for a, i, h in zip(anchor.tolist(), index.tolist(), home.tolist()):
        if h:
            at_home.setdefault(i, set()).add(a)
    everywhere = {}
    for a, i in zip(anchor.tolist(), index.tolist()):
        everywhere.setdefault(i, set()).add(a)
    assert all(at_home[k - 1] & everywhere[k] for k in range(1, 300, 2))


@pytest.mark.parametrize("members", [7, 8192])
def test_dense_group_is_one_component(spark, monkeypatch, members):
    """All fingerprints around one centre; a small limit deals the anchors out in blocks."""
    monkeypatch.setattr(simhash, "ANCHOR_MEMBERS", members)
    centre = 0x0123456789ABCDEF
    near = [centre ^ (1 << a) ^ (1 << b) for a in range(0, 60, 6) for b in range(a + 1, 64, 9)]
    far = [centre ^ (0x1F << s) for s in (0, 30)]
    signed = [(p if p < 1 << 63 else p - (1 << 64),) for p in near + far]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"), 3).collect()
    assert len(edges) < 12 * len(near)
    unsigned = lambda v: v % (1 << 64)
    root = {p: p for p in near + far}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in edges:
        assert (unsigned(a) ^ unsigned(b)).bit_count() <= 64
        root[find(unsigned(a))] = find(unsigned(b))
    got, want = {p: find(p) for p in root}, plain_components(set(near + far), 3)
    pairs = lambda of: {(a, b) for a in of for b in of if of[a] == of[b]}
    assert pairs(got) == pairs(want)


# suffix dedup


def plain_repeats(rows, length):
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0], r[1], np.int64(np.uint64(xxhash.xxh64_intdigest(r[2].encode(), 42)))))
    for known, number, text in order:
        data = text.encode()
        hit = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                hit[p : p + length] = b"\1" * length
            seen[window] = True
        spans = len(re.findall(b"\1+", bytes(hit)))
        kept = bytes(b for b, h in zip(data, hit) if not h)
        out.append((number if known else None, len(data), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def suffix_result(docs, **options):
    from pyspark.sql import functions as F

    kept = without_spans(identified(docs), suffix_dedup.repeated_spans(docs, **options))
    return kept.select("_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))


@pytest.mark.parametrize("crowded", [3, 50_000])
def test_suffix_dedup(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "GRAM_ROWS", crowded)
    rows = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t in odd_rows()]
    plain = plain_repeats(sorted({(i is not None, i or 0, t or "") for i, t in rows}), 100)
    want = sorted((r for i, t in rows for r in plain if r[0] == i and r[1] == len((t or "").encode())), key=repr)
    got = collected(suffix_result(documents(spark, rows)))
    # two rows of one id and length would be counted twice above
    assert len(want) == len(got)
    assert got == want


def test_suffix_dedup_in_small_pieces(spark, monkeypatch):
    """Open windows are compared a few rows at a time, and never more than a gram's rows or the piece."""
    keys, most = suffix_dedup._window_keys, spark.sparkContext.accumulator(0)

    def counted(a, *rest):
        most.add(len(a) > 12)
        return keys(a, *rest)

    monkeypatch.setattr(suffix_dedup, "PIECE_ROWS", 5)
    monkeypatch.setattr(suffix_dedup, "GRAM_ROWS", 7)
    monkeypatch.setattr(suffix_dedup, "_window_keys", counted)
    common = passage(1, 30)
    rows = [(k, f"{passage(1000 + k, 20)} {passage(100 + k % 40, 24)} {common if k % 4 else ''} {passage(3000 + k, 20)}") for k in range(80)]
    assert collected(suffix_result(documents(spark, rows))) == sorted(plain_repeats([(True, i, t) for i, t in rows], 100), key=repr)
    assert most.value == 0


@pytest.mark.parametrize("at_run_time", ["-1", "10m"])
def test_suffix_dedup_whatever_the_joins(spark, monkeypatch, at_run_time):
    """Few grams are crowded, and Spark may find only at run time that a join's side is small: a gram's rows still meet in one task."""
    monkeypatch.setattr(suffix_dedup, "GRAM_ROWS", 20)
    common, pairs = passage(1, 40), [passage(100 + k, 24) for k in range(40)]
    rows = [(k, f"{passage(1000 + k, 20)} {pairs[k % 40]} {passage(2000 + k, 9)} {common if k % 2 else ''} {passage(3000 + k, 20)}") for k in range(80)]
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": at_run_time,
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        got = collected(suffix_result(documents(spark, rows)))
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert got == sorted(plain_repeats([(True, i, t) for i, t in rows], 100), key=repr)


def test_suffix_dedup_of_patterned_bytes(spark):
    """A small alphabet and a short length: periods, overlaps, repeats inside one document."""
    draw = np.random.default_rng(5)
    texts = ["".join(draw.choice(list("ab"), 400)) for _ in range(6)] + ["ab" * 150, "a" * 200, "aab" * 100]
    texts += [texts[0][50:250] + texts[1][20:90], texts[2], texts[3][:333] + "é" + texts[3][100:]]
    rows = list(enumerate(texts))
    want = plain_repeats([(True, i, t) for i, t in rows], 24)
    assert collected(suffix_result(documents(spark, rows), length=24, gram=8)) == sorted(want, key=repr)


def test_suffix_dedup_of_nothing(spark):
    assert collected(suffix_result(documents(spark, []))) == []


def test_places_of_repeated_grams(spark):
    """One pass over the texts and one exchange, with the places that a plain count of the grams gives."""
    common = passage(3, 40)
    texts = [passage(50 + k, 30) + (common if k % 3 else "") + passage(90 + k % 7, 30) for k in range(40)] + ["x" * 300, "", None, "short"]
    docs = identified(documents(spark, list(enumerate(texts))).repartition(3))
    found = suffix_dedup._places(docs, 100, 32)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("hashpartitioning") == 1
    text, place, hashes, _, _ = suffix_dedup.anchors([(t or "").encode() for t in texts], 100, 32)
    often = Counter(hashes.tolist())
    want = sorted((x, a) for x, a, h in zip(text.tolist(), place.tolist(), hashes.tolist()) if often[h] > 1)
    names = {r._doc: r._id for r in docs.select(suffix_dedup._document().alias("_doc"), "_id").collect()}
    assert sorted((names[r._doc], r.a) for r in found.collect()) == want and 0 < len(want) < len(text)


def test_planted_passages_of_over_50_words(spark):
    """A passage set into two texts goes from the later one, whole but for its edges' chance; other texts keep every byte."""
    rows = [(k, passage(1000 + k, 120)) for k in range(60)]
    planted = {}
    for k in range(0, 40, 2):
        words = passage(5000 + k, 55)
        for x in (k, k + 1):
            own = rows[x][1].split(" ")
            rows[x] = (x, " ".join([*own[: 20 + x], words, *own[20 + x :]]))
        planted[k + 1] = len(words)
    got = {r[0]: r[2] for r in collected(suffix_result(documents(spark, rows)))}
    assert {x for x, n in got.items() if n} == set(planted)
    assert all(planted[x] <= got[x] <= planted[x] + 40 for x in planted)


def plain_anchors(text, length, gram):
    """Each window's leftmost smallest gram, as (place, first window, last window)."""
    hashes = suffix_dedup._mix(suffix_dedup._rolling(np.frombuffer(text, np.uint8), gram, suffix_dedup._BASES[0])).tolist()
    out = []
    for p in range(len(text) - length + 1):
        own = hashes[p : p + length - gram + 1]
        pick = p + own.index(min(own))
        if out and out[-1][0] == pick:
            out[-1][2] = p
        else:
            out.append([pick, p, p])
    return out


@pytest.mark.parametrize("at_once", [333, 1 << 19])
def test_anchors(monkeypatch, at_once):
    monkeypatch.setattr(suffix_dedup, "_AT_ONCE", at_once)
    texts = [passage(7, 300).encode(), b"", None, b"short", b"a" * 700, b"ab" * 400, b"x" * 99 + b"y", (passage(8, 9) * 20).encode()]
    text, place, _, first, last = suffix_dedup.anchors(texts, 100, 32)
    got = [[] for _ in texts]
    for row in zip(text.tolist(), place.tolist(), first.tolist(), last.tolist()):
        got[row[0]].append(list(row[1:]))
    assert got == [plain_anchors(t or b"", 100, 32) if len(t or b"") >= 100 else [] for t in texts]


# chunk dedup


def plain_chunks(rows, low, high, bits, least):
    gear = chunk_dedup.GEAR.tolist()
    mask = ((1 << bits) - 1) << (32 - bits)
    first, cuts = {}, {}
    order = sorted(rows, key=lambda r: (r[0], r[1], np.int64(np.uint64(xxhash.xxh64_intdigest(r[2].encode(), 42)))))
    for row in order:
        data, last, h, ends = row[2].encode(), 0, 0, []
        for at, byte in enumerate(data, 1):
            h = (h << 1) + gear[byte] & 0xFFFFFFFF
            if at - last == high or (h & mask == 0 and at - last >= low):
                ends.append(at)
                last = at
        if last < len(data):
            ends.append(len(data))
        cuts[row] = list(zip([0, *ends], ends))
        for k, (a, b) in enumerate(cuts[row]):
            if b - a >= low:
                first.setdefault(data[a:b], (row, k))
    out = {}
    for row in order:
        data = row[2].encode()
        fresh = [b - a < low or first[data[a:b]] == (row, k) for k, (a, b) in enumerate(cuts[row])]
        kept, k = [], 0
        while k < len(fresh):
            end = k + 1
            while end < len(fresh) and fresh[end] == fresh[k]:
                end += 1
            run = data[cuts[row][k][0] : cuts[row][end - 1][1]]
            kept += [run] if fresh[k] or len(run) < least else []
            k = end
        out[row] = hashlib.sha256(b"".join(kept)).hexdigest()
    return out


@pytest.mark.parametrize("least", [0, 96])
def test_chunk_dedup(spark, least):
    from pyspark.sql import functions as F

    plain = plain_chunks(distinct_rows(), 32, 200, 5, least)
    want = sorted(((i, plain[(i is not None, i or 0, t or "")]) for i, t in odd_rows()), key=repr)
    docs = documents(spark)
    kept = without_spans(identified(docs), chunk_dedup.repeated_chunks(docs, min_bytes=32, max_bytes=200, mask_bits=5, min_run=least))
    assert collected(kept.select("_id", F.sha2("kept", 256))) == want


def test_chunks_fall_into_step_after_an_insertion():
    text = passage(11, 2000).encode()
    moved = text[:700] + b"inserted" + text[700:]
    pieces = [set(), set()]
    for own, t in zip(pieces, (text, moved)):
        at = 0
        for end in chunk_dedup.chunk_ends(t, 64, 1024, 6):
            own.add(t[at:end])
            at = end
    assert len(pieces[0] & pieces[1]) >= len(pieces[0]) - 4


def test_chunk_dedup_of_nothing(spark):
    assert collected(chunk_dedup.repeated_chunks(documents(spark, []))) == []


# quality


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    hit = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    lines = [line for line in (text or "").split("\n") if line.strip(BLANK)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_quality(spark):
    rows = [*odd_rows(), (50, "one two three four five six " * 3 + "seven"), (51, "a b c d e a b c d e a b c d e"), (52, "#$% & | < > *")]
    got = quality.judged(documents(spark, rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    assert collected(got) == sorted(((i, *plain_quality(t)) for i, t in rows), key=repr)


def test_quality_rules_name_what_failed(spark):
    rule = (quality.Rule("symbol_ratio", highest=0.01), quality.Rule("mean_word_length", 2.0))
    frame = documents(spark, [(1, "word " * 3 + " ".join(f"w{k}" for k in range(20))), (2, "a # b $ c % d & e f g h i j k"), (3, None)])
    got = {r["doc_id"]: (r["failed_rules"], r["kept"]) for r in quality.judged(frame, rules=rule).collect()}
    assert got == {1: ([], True), 2: (["symbol_ratio", "mean_word_length"], False), 3: (["mean_word_length"], False)}
    assert collected(quality.judged(documents(spark, []))) == []


# decontamination


def plain_hits(rows, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    named = [(i, word.findall(lower(t or ""))) for i, t in items]
    out = []
    for doc, text in rows:
        words = word.findall(lower(text or ""))
        hit, found = set(), set()
        for item, own in named:
            n = min(window, len(own))
            for o in range(len(own) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[o : o + n]:
                        hit.update(range(p, p + n))
                        found.update([item] if item is not None else [])
        out.append((doc, len(words), len(hit), sorted(map(str, found)), bool(hit)))
    return out


ITEMS = [(1, passage(1).upper()), (2, passage(3, 20)), (3, "Common line"), (4, None), (5, ""), (10, passage(1)), (None, "short"), (7, "a a a")]


@pytest.mark.parametrize("block", [40, 200_000])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rows = [(i, (t or "")[:3000] if t else t) for i, t in odd_rows()]
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.contamination(documents(spark, rows), benchmark).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    want = plain_hits(rows, ITEMS, 10)
    if block == 40:
        # several passes: rows of one id and number of words are one
        assert {repr(r) for r in collected(got)} == {repr(r) for r in want}
    else:
        assert collected(got) == sorted(want, key=repr)


def test_blocks_make_no_difference(spark, monkeypatch):
    """Repeated rows, and other texts of the same length with equal or null ids; all columns, as multisets."""
    draw = passage(3, 20)
    rows = [(i, t if t is None else t[:3000]) for i, t in odd_rows()]
    rows += [(None, draw), (None, passage(60, 20)), (20, draw), (20, passage(61, 20)), (20, draw), (21, f"{passage(1)} {draw}")]
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string").coalesce(1).cache()
    found = []
    for block in (40, 200_000):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        docs = documents(spark, rows)
        found.append((collected(decontaminate.matches(docs, benchmark)), collected(decontaminate.contamination(docs, benchmark))))
    assert found[0] == found[1]
    got = sorted(((r[0], r[1], *r[4:5], *r[5:6]) for r in found[0][1]), key=repr)
    want = sorted(((doc, n, hit, items) for doc, n, hit, items, _ in plain_hits(rows, ITEMS, 10)), key=repr)
    assert got == want


def test_longest_match_and_its_place(spark):
    benchmark = spark.createDataFrame([(1, passage(1))], "item_id bigint, text string")
    inner = " ".join(passage(1).split()[5:45])
    docs = documents(spark, [(1, f"before it {inner} after it")])
    row = decontaminate.matches(docs, benchmark).first()
    assert [tuple(m) for m in row["matches"]] == [("1", 2, 5, 40)]


def test_contamination_with_empty_tables(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert collected(decontaminate.contamination(documents(spark, []), benchmark)) == []
    clean = decontaminate.contamination(documents(spark), benchmark.limit(0))
    assert clean.filter("contaminated").count() == 0 and clean.count() == len(odd_rows())
