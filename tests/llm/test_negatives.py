"""Hard negatives against brute force, and their certain intervals."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, row long, x string"


def brute(rows, anchors, positives=5, negatives=10):
    """All of (anchor, positive, rank, negative, scores), from clean rows (id, vector, label) in any order."""
    size = max(len(v) for _, v, _ in rows)
    q = [[math.floor(256 * float(np.float32(x))) for x in v] + [0] * (size - len(v)) for _, v, _ in rows]
    last = 1 << 70
    out = []
    for a, (i, _, label) in enumerate(rows):
        if i is None or not anchors(i):
            continue
        scored = [(-sum(x * y for x, y in zip(q[a], q[b])), last if rows[b][0] is None else rows[b][0], b) for b in range(len(rows)) if b != a]
        near = sorted(s for s in scored if rows[s[2]][2] == label)[:positives]
        for minus, _, p in near:
            band = sorted(s[:2] for s in scored if rows[s[2]][2] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus)[:negatives]
            out += [(i, rows[p][0], k, None if b == last else b, -minus, -s) for k, (s, b) in enumerate(band, 1)]
    return sorted(out, key=repr)


def found(spark, rows, anchors):
    made = h.hard_negatives(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), anchors)
    return sorted((tuple(r) for r in made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    """Clusters, ties by copies of vectors, null and repeated ids; blocks of a few rows and anchors."""
    monkeypatch.setattr(h, "ROWS", 40)
    monkeypatch.setattr(h, "ANCHORS", 7)
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((4, 70))
    vectors = [(centers[i % 4] + rng.standard_normal(70) * 1.5) / 14 for i in range(230)]
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(vectors)]
    rows += [(500 + i, vectors[3].tolist(), i % 2) for i in range(25)] + [(None, vectors[8].tolist(), 1), (40, vectors[9].tolist(), 0), (40, vectors[9].tolist(), 0), (700, [], 1), (701, [0.3, -0.2], 2)]
    random.Random(1).shuffle(rows)
    bad = [(2_000, None, 1), (2_010, vectors[0].tolist(), None), (2_020, [1.0, None], 1), (2_030, [float("nan"), 1.0], 1), (2_040, [float("inf")], 1)]
    assert found(spark, rows + bad, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.25, 0.0], 0), (3, [-1.0, 0.0], 0)]
    assert found(spark, rows, F.col("vec_id") == 0) == [(0, 1, 1, 2, 256 * 128, 256 * 64)]
    assert found(spark, rows[2:], F.col("vec_id") == 2) == [] and found(spark, [], F.col("vec_id") == 2) == []


def test_intervals_hold_every_score():
    rng = np.random.default_rng(2)
    for size in (64, 192):
        x = np.floor(rng.standard_normal((300, size)) * rng.choice([1, 30, 3000], (300, 1))).astype("int64")
        x[:3] = [[0] * size, [1] * size, [-7] + [0] * (size - 1)]
        coded, queries = h.encode(x), h.Queries(x[:40])
        low, high = queries.intervals(slice(0, 40), coded["codes"], coded["alignment"], coded["rest"], coded["norm"])
        true = x[:40] @ x.T
        assert (low <= true).all() and (true <= high).all()
        # half an interval is a tenth of the lengths' product or so
        scale = coded["norm"][:40, None] * coded["norm"] + 1
        assert np.median((high - low) / scale) < 0.3
