"""Quality scores from preferences: plain versions of the parts, and held-out labels."""

import random

import numpy as np
import pytest

from sensorloom.llm import quality_rank as qr
from sensorloom.llm.queries import QUERIES
from tests.llm.frames import LONG, collected, documents, odd_rows

SF = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int, _id string, _x string"


def labels(spark, rows):
    return spark.createDataFrame([(i, q, 0, "a", "b") for i, q in rows], LABELS)


def good_and_bad(n=60):
    draw = random.Random(3)
    rows = []
    for k in range(n):
        w = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(15, 60))]
        rows.append((k, " ".join(w).capitalize() + "." if k % 3 else " ".join(x.upper() + "##" for x in w)))
    return rows


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = (LONG[:4000] + "\nSame line\n\nSame line\n É! " + "x" * 300 + "  12 12 12 ").encode()
    whole = qr.features(text)
    assert abs(float((whole[: qr.KINDS**2] ** 2).sum()) - 1) < 1e-5
    monkeypatch.setattr(qr, "_PIECE", 50)
    assert np.allclose(qr.features(text)[:-4], whole[:-4]) and whole[-2] == qr.features(text)[-2]
    assert not qr.features(None).any() and not qr.features(b"").any()
    assert np.isfinite(qr.features(b"  \n ")).all()


def test_scores_order_labels_and_stand_odd_rows(spark):
    rows = good_and_bad()
    docs = documents(spark, rows + odd_rows()[:13] + [(3, rows[3][1])])
    known = labels(spark, [(i, int(i % 3 > 0)) for i, _ in rows] + [(7777, 1), (None, 1), (5, None), (4, 0)])
    described = qr.described(docs)
    model = qr.fit(described, known)
    got = qr.score(described, model).collect()
    assert len(got) == len(rows) + 14
    assert all(0 <= r["score"] <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["_id"], []).append(r["score"])
    for i, _ in rows[20:]:
        assert (by_id[i][0] >= qr.CUT) == (i % 3 > 0)


def test_without_labels_of_both_kinds(spark):
    described = qr.described(documents(spark, good_and_bad(9)))
    for known, share in (([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)):
        model = qr.fit(described, labels(spark, known))
        assert {r["score"] for r in qr.score(described, model).collect()} == {share}
    empty = qr.described(documents(spark).limit(0))
    assert qr.score(empty, qr.fit(empty, labels(spark, [(1, 1)]))).count() == 0


def test_pairs_weights_and_threshold_as_plain_versions(spark):
    rows = good_and_bad(40)
    described = qr.described(documents(spark, rows))
    # labels that the features do not separate
    known = [(i, int((i * 7) % 10 < 6)) for i, _ in rows]
    x = {i: qr.features(t.encode()).astype(float) for i, t in rows}
    model = qr.fit(described, labels(spark, known), penalty=0.01)
    good = [i for i, q in known if q]
    bad = [i for i, q in known if not q]

    def part(ids):
        frame = described.where(described["_id"].isin(ids))
        return qr.shuffled(frame, qr.digest(frame["_id"], qr.F.xxhash64("_x"), 1), ["_id"], "_position", "_rows")

    pairs = qr.preferences(part(good), part(bad), qr.MATCHES, 1)
    d = np.array([r["_d"] for r in pairs.collect()])
    assert len(d) == qr.MATCHES * max(len(good), len(bad))
    # every difference is one of a good and a bad text
    every = {tuple(np.round(x[a].astype(np.float32) - x[b].astype(np.float32), 5)) for a in good for b in bad}
    assert {tuple(np.round(v.astype(np.float32), 5)) for v in d} <= every
    scale = np.sqrt((d * d).mean(0))
    used = scale > 0
    w = model.weights[used] * scale[used]
    z = d[:, used] / scale[used] @ w
    gradient = -(d[:, used] / scale[used] / (1 + np.exp(z))[:, None]).mean(0) + 0.01 * w
    assert np.abs(gradient).max() < 1e-5 and not model.weights[~used].any()
    scores = sorted(np.rint(x[i].astype(np.float32).astype(float) @ model.weights * qr.SCORE_STEPS) for i, _ in known)
    middle = (scores[len(bad) - 1] + scores[len(bad)]) / 2
    assert abs(model.threshold * qr.SCORE_STEPS - middle) <= 2


def test_held_out_labels(spark):
    got = QUERIES["op11_quality_rank"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert [t for _, t in got.dtypes] == ["bigint", "boolean", "double", "int"]
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [(r["score"], r["predicted"], known[r["doc_id"]]) for r in got.collect() if r["held_out"] and r["doc_id"] in known]
    assert len(out) > 50
    assert np.mean([p == q for _, p, q in out]) >= 0.95
    pairs = [(a > b) + 0.5 * (a == b) for a, _, q in out if q for b, _, r in out if not r]
    assert np.mean(pairs) >= 0.99
