"""Cuts at token boundaries against a plain version on code points."""

import hashlib
import random
import re

import numpy as np
import pytest

from sensorloom.llm import fill_middle as fim
from tests.llm.frames import collected, documents, odd_rows

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_version(doc_id, text, seed=1, rates=fim.Rates()):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 100 - rates.plain:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = ("".join(p) for p in (tokens[:low], tokens[low:high], tokens[high:]))
    if h[3] % 100 < rates.suffix_first:
        return doc_id, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


ROWS = odd_rows() + [
    (200 + k, t)
    for k, t in enumerate(
        ["a<P>b", "<S>", "x <M> y", "<p>lower</p>", "é", "Zürich漢字x1\U0001f600ab", "\n", "a" * 70_000, "a " * 70_000, "漢" * 30_000 + "ab" * 40_000, "<", "<P"]
    )
]


def test_cuts_and_forms_as_the_plain_version(spark):
    docs = documents(spark, ROWS)
    assert collected(fim.fill_middle(docs)) == sorted((plain_version(i, t) for i, t in ROWS), key=repr)
    other = fim.Rates(plain=50, suffix_first=50)
    assert collected(fim.fill_middle(docs, seed=9, rates=other)) == sorted((plain_version(i, t, 9, other) for i, t in ROWS), key=repr)
    assert fim.fill_middle(docs.limit(0)).count() == 0


def test_round_trip(spark):
    docs = documents(spark, ROWS)
    done = fim.fill_middle(docs, rates=fim.Rates(plain=0, suffix_first=50))
    back = done.select("doc_id", fim.restored(done["output"], done["form"]).alias("text"))
    assert collected(back) == sorted(((i, t or "") for i, t in ROWS), key=repr)


@pytest.mark.parametrize(
    ("members", "kind"),
    [
        (list(range(0, 60_000, 1000)), fim.ArrayContainer),
        (list(range(65_536)), fim.RunContainer),
        (list(range(5, 9000)) + list(range(20_000, 65_536)), fim.RunContainer),
        (sorted(random.Random(1).sample(range(65_536), 30_000)), fim.BitmapContainer),
        (sorted(random.Random(2).sample(range(65_536), 4096)), fim.ArrayContainer),
        (sorted(random.Random(3).sample(range(65_536), 4097)), fim.BitmapContainer),
    ],
)
def test_select_in_each_container(members, kind):
    held = fim.container(np.array(members))
    assert isinstance(held, kind)
    assert [held.select(k) for k in range(0, len(members), 7)] == members[::7]
    assert held.select(len(members) - 1) == members[-1]


def test_select_over_containers():
    draw = random.Random(4)
    text = "".join(draw.choice(["word", " ", "x", ".", "é", "漢", "\U0001f600", "longerword" * 50]) for _ in range(30_000)) + "a" * 200_000 + "!"
    ends = np.cumsum([0] + [len(t.encode()) for t in TOKEN.findall(text)])
    held = fim.token_ends(text.encode())
    assert len(held) == len(ends)
    assert len(held.keys) < len(held.cumulative) + 1 and 1 in held.keys
    assert [held.select(k) for k in range(0, len(ends), 11)] == ends[::11].tolist()
    assert held.select(len(ends) - 1) == len(text.encode())


@pytest.mark.parametrize("size", [65_535, 65_536, 65_537, 131_072])
def test_edges_of_containers(size):
    for text in ("a" * size, "a" * (size - 1) + ".", "." * size, "." * (size - 2) + "ab"):
        held = fim.token_ends(text.encode())
        ends = np.cumsum([0] + [len(t) for t in TOKEN.findall(text)])
        assert len(held) == len(ends)
        assert [held.select(k) for k in (0, len(ends) // 2, len(ends) - 2, len(ends) - 1)] == [int(ends[k]) for k in (0, len(ends) // 2, len(ends) - 2, len(ends) - 1)]
