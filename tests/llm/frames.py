"""Small frames with the odd cases every operator must stand."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _text string, tokens string, keep string, component_id string"
LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(60_000))


def passage(seed, words=60):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(words))


def odd_rows():
    """(doc_id, text): nulls, empty and blank texts, a very long text, ties, repeated rows, copies and near copies."""
    shared, other = passage(1), passage(2, 90)
    near = other.split()
    near[40] = "changed"
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n \x0b\x0c\r "),
        (4, LONG),
        (5, shared),
        (6, shared),
        (6, shared),
        (7, other),
        (8, " ".join(near)),
        (8, "a different text with the same id"),
        (None, shared),
        (None, None),
        (None, "text without an id, Éa and ÉA\nSame\n same \nSAME"),
        (9, "naïve façade — “quotes” 漢字 かな\n\n\nTail"),
        (10, "short"),
        (11, f"{passage(3, 20)} {shared} {passage(4, 20)}"),
        (12, "a " * 300),
        (13, "x" * 500),
    ]
    rows += [(100 + k, f"Common LINE\n{passage(50 + k, 15)}\n  common line\t") for k in range(14)]
    return rows


def documents(spark, rows=None):
    """The rows as documents with extra columns whose names clash with what operators use inside."""
    full = [(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}", None, "x", "y", "z", None, "c") for i, t in (odd_rows() if rows is None else rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
