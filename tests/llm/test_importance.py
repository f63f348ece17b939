"""Importance draws and the selection of the cut-off key against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from sensorloom.llm import importance, selection
from sensorloom.session import keep
from tests.llm.frames import LONG, SCHEMA, collected, documents, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def buckets(text, size):
    w = words(text)
    return Counter(crc32(" ".join(w[i : i + n]).encode()) % size for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain_version(rows, target, percent, min_words, seed, size):
    s, t = Counter(), Counter()
    for _, text in rows:
        s += buckets(text, size)
    for text in target:
        t += buckets(text, size)
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + size) / ((s[b] + 1) * (m + size)))) for b in range(size)]
    scored = []
    for i, text in rows:
        found = buckets(text, size)
        weight = sum(gain[b] * k for b, k in found.items())
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append([i, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    order = sorted((r for r in scored if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(order[: len(order) * percent // 100])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in scored), key=repr)


TARGET = ["Common LINE and some words of a benchmark", "a a a a", None, "", "word1x1 word2x2"]


@pytest.mark.parametrize(("percent", "min_words", "seed", "size"), [(5, 20, 42, 10_000), (40, 3, 7, 50), (100, 0, 1, 997)])
def test_draw_as_the_plain_version(spark, percent, min_words, seed, size):
    # rows of equal id and equal score would be ordered by a digest, so ids are made different here
    rows = [(None if i is None and k == 13 else k, t) for k, (i, t) in enumerate(odd_rows())]
    target = documents(spark, [(k, t) for k, t in enumerate(TARGET)])
    got = importance.resample(documents(spark, rows), target, percent=percent, min_words=min_words, seed=seed, buckets=size)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collected(got) == plain_version(rows, TARGET, percent, min_words, seed, size)


def test_repeated_rows_ties_and_empty_tables(spark):
    rows = odd_rows() + [(6, odd_rows()[4][1])] * 30
    docs, target = documents(spark, rows), documents(spark, [(1, "x")])
    got = importance.resample(docs, target, percent=50, min_words=1).collect()
    assert len(got) == len(rows)
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    eligible = [r for r in rows if len(words(r[1])) >= 1]
    assert ranks == list(range(1, len(eligible) // 2 + 1))
    placed = sorted((r["rank"], -r["score"]) for r in got if r["rank"] is not None)
    assert [s for _, s in placed] == sorted(s for _, s in placed)
    assert importance.resample(docs.limit(0), target).count() == 0
    bare = importance.resample(docs, spark.createDataFrame([], SCHEMA), percent=50, min_words=1)
    assert bare.count() == len(rows)
    named = importance.resample(docs.withColumnRenamed("doc_id", "n").drop("_id"), target, percent=50, min_words=1, id_col="_text", text_col="text")
    assert sum(r["rank"] is not None for r in named.collect()) == len(eligible) // 2


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = (LONG[:3000] + " Éa, b! " + "x" * 100 + " \n\n ... " + "one two three").encode()
    whole = buckets(text.decode(), 9973)
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(importance, "_PIECE", size)
        found = Counter()
        for _, part in importance.feature_buckets(text, 9973):
            found.update(part.tolist())
        assert found == whole


@pytest.mark.parametrize("spread", [3, 1000])
def test_kth_key(spark, monkeypatch, spread):
    draw = random.Random(spread)
    rows = [(draw.randrange(-spread, spread), draw.randrange(spread)) for _ in range(4000)]
    # one value holds a third of all rows
    rows += [(1, 1)] * 2000
    stored = keep(spark.createDataFrame(rows, "a bigint, b bigint").repartition(7), "test_keys")
    ordered = sorted(rows)
    for k in (0, 1, 2999, 3500, 5998, 5999):
        assert selection.kth_key(stored, k, finish=1) == ordered[k]
        assert selection.kth_key(stored, k) == ordered[k]
    with pytest.raises(ValueError):
        selection.kth_key(stored, 6000)


def test_portions_and_pivots(monkeypatch):
    draw = np.random.default_rng(5)
    keys = draw.integers(-50, 50, (5000, 3))
    ordered = sorted(map(tuple, keys.tolist()))
    assert [selection._nth(keys, n) for n in range(0, 5000, 501)] == ordered[::501]
    # each side of the weighted median of medians holds a quarter of the keys at least
    parts = np.array_split(keys[np.argsort(keys[:, 0])], [10, 700, 2500])
    pivot = selection.weighted_median([(tuple(selection._median(p)), len(p)) for p in parts])
    assert sum(k <= pivot for k in ordered) >= 1250 and sum(k >= pivot for k in ordered) >= 1250
