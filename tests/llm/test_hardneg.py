"""Dual-tree search against all inner products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hardneg as H

SCHEMA = "vec_id long, label int, embedding array<float>"


def all_pairs(rows, every, positives=5, negatives=3):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by looking at every row; q as lists of whole numbers."""
    one = {}
    for i, label, q in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        one.setdefault(i, (label, q))
    out = []
    for a, (label, q) in one.items():
        if a % every:
            continue
        score = lambda o: sum(x * y for x, y in zip(q, o))
        scored = sorted((-score(o), i, lab == label) for i, (lab, o) in one.items() if i != a)
        for p, i, _ in [s for s in scored if s[2]][:positives]:
            hard = [(s, j) for s, j, own in scored if not own and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, every, **sizes):
    table = spark.createDataFrame(rows, "vec_id long, label long, q array<long>")
    return sorted(tuple(r) for r in H.mine(table, F.col("vec_id") % every == 0).collect())


def clustered(n, dim, seed, spread=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 100, (6, dim))
    at = rng.integers(0, 6, n)
    q = np.floor(centres[at] + rng.normal(0, spread, (n, dim))).astype(int)
    return [(int(i), int(rng.integers(0, 3)), list(map(int, v))) for i, v in enumerate(q)]


def test_all_are_found_in_small_blocks(spark, monkeypatch):
    rows = clustered(900, 5, 1)
    rows += [(2000 + i, i % 2, rows[7][2]) for i in range(150)]  # copies of one vector
    rows += [(3000, 0, [0] * 5), (3001, 1, [0] * 5), (3002, 1, []), (3003, 1, [4, -4]), (3010, 0, [5]), (1, 2, rows[1][2]), (1, 0, rows[1][2])]
    for name, value in (("BLOCK", 16), ("SLAB", 60), ("GROUP", 20), ("ANCHOR_LEAF", 4), ("LEAST_SLABS", 8)):
        monkeypatch.setattr(H, name, value)
    sizes = {"sample": 100, "block": 16, "slab": 60, "least_slabs": 8}
    plain = H.index
    monkeypatch.setattr(H, "index", lambda rows, folder, **_: plain(rows, folder, **sizes))
    within = H.best_within
    monkeypatch.setattr(H, "best_within", lambda *a, **b: within(*a, **b, group=20))
    assert mined(spark, rows, 10) == all_pairs(rows, 10)


def test_pairs_of_nodes_are_passed_over():
    """Far clusters are not scored, and every inner product lies in its interval."""
    rng = np.random.default_rng(2)
    near, far = rng.normal(0, 1, (64, 4)) + [50, 0, 0, 0], rng.normal(0, 1, (64, 4)) - [50, 0, 0, 0]
    anchors = rng.normal(0, 1, (32, 4)) + [50, 0, 0, 0]
    balls = lambda m: H.Balls(*map(np.array, zip(*(H.ball(m[i : i + 8]) for i in range(0, len(m), 8)))))
    blocks = np.vstack([near, far])
    seen = []
    H.search(balls(anchors), balls(blocks), np.full(4, 1000.0), np.full(4, np.inf), lambda a, c: seen.append((a, c)))
    assert seen and {c for _, c in seen} <= set(range(8))
    for _ in range(200):
        a, b = rng.normal(0, rng.uniform(0.1, 30), (9, 6)) + rng.normal(0, 20, 6), rng.normal(0, rng.uniform(0.1, 30), (7, 6)) + rng.normal(0, 20, 6)
        low, high = H.interval(*H.ball(a), *H.ball(b))
        got = a @ b.T
        assert low <= got.min() and got.max() <= high


def test_large_numbers_are_exact():
    a, b = np.array([[2**30 + 1, 3]]), np.array([[2**30 - 1, 5], [1, 2**31]])
    assert H.products(a, b).tolist() == [[2**60 - 1 + 15, 2**30 + 1 + 3 * 2**31]]
    for m in ([[1, -2]], [[40_000, 0]], [[2**40, -5]]):
        raw, kind = H.pack(np.array(m))
        assert H.unpack(raw, kind, 1).tolist() == m


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, None, [1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [nan]), (5, 1, [inf]), (6, 1, [-inf]), (None, 1, [1.0]), (7, 0, [-0.001, 0.999])]
    got = H.usable(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", q string"))
    assert {(r.vec_id, r.label, tuple(r.q)) for r in got.collect()} == {(0, 1, (256, 128)), (7, 0, (-1, 255))}


def test_small_and_empty_tables(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(0, 1, [1, 2])], 1) == []
    rows = [(i, i % 2, [10 + i, 3]) for i in range(9)]
    assert mined(spark, rows, 1) == all_pairs(rows, 1)
    assert mined(spark, [(i, i % 2, []) for i in range(4)], 1) == all_pairs([(i, i % 2, []) for i in range(4)], 1)
