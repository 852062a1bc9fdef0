"""Scans over blocks of any size against computations over whole series."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import islands as I, markov as M, scan as S

A3 = np.array([[0.9, 0.07, 0.03], [0.1, 0.8, 0.1], [0.0, 0.2, 0.8]])
MODELS = {"a": ([0.6, 0.4], A3[:2, :2] / A3[:2, :2].sum(1, keepdims=True), [0.0, 1.0], [0.5, 2.0]), None: ([0.2, 0.3, 0.5], A3, [0.0, 0.5, -1.0], [0.4, 1.0, 3.0])}


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    x = {k: rng.normal(0, rng.choice([0.5, 2.0], n)) for k, n in (("a", 157), (None, 231), ("no model", 5))}
    rows = [(k, t, float(v)) for k, xs in x.items() for t, v in enumerate(xs)]
    rows += [("a", 1000, None)]
    random.Random(1).shuffle(rows)
    return x, spark.createDataFrame(rows, "k string, t int, v double")


@pytest.fixture(scope="module")
def models(spark):
    rows = [(k, list(map(float, pi)), [list(map(float, r)) for r in a], list(map(float, mu)), list(map(float, s))) for k, (pi, a, mu, s) in MODELS.items()]
    return spark.createDataFrame(rows, "k string, pi array<double>, a array<array<double>>, mu array<double>, sigma array<double>")


def batch(model):
    pi, a, mu, sigma = (np.asarray(p, float)[..., None] for p in model)
    return pi, a, mu, sigma


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_states_of_blocks_are_those_of_the_whole(spark, series, models, size):
    x, rows = series
    got = S.chain_states(rows, models, ["k"], "v", "t", size).toPandas()
    path = S.likely_path(rows, models, ["k"], "v", "t", size).toPandas()
    assert set(got.k.map(str)) == {"a", "None"}
    for k, model in MODELS.items():
        m = batch(model)
        own = got[got.k.isna() if k is None else got.k == k].sort_values("t")
        alpha, ll, _ = M.filtered(x[k], m)
        gamma, _, _ = M.expectation(x[k], m)
        assert len(own) == len(x[k])
        np.testing.assert_allclose(np.stack(own.filtered), alpha[:, 0].T, atol=1e-9)
        np.testing.assert_allclose(np.stack(own.smoothed), gamma[:, 0].T, atol=1e-9)
        ahead = np.vstack([m[0][:, 0], alpha[:, 0, :-1].T @ m[1][..., 0]])
        np.testing.assert_allclose(own["mean"], ahead @ m[2][:, 0], atol=1e-9)
        states = path[path.k.isna() if k is None else path.k == k].sort_values("t").state
        assert states.tolist() == M.most_likely_path(x[k], m).tolist()
    lls = {r.k: r.ll for r in S.chain_loglik(S.series_blocks(rows, ["k"], "v", "t", size), models, ["k"]).collect()}
    assert lls == pytest.approx({k: M.filtered(x[k], batch(m))[1][0] for k, m in MODELS.items()}, abs=1e-7)


def test_em_step(spark, series, models):
    x, rows = series
    for size in (9, 10_000):
        got = {r.k: r for r in S.em_step(S.series_blocks(rows, ["k"], "v", "t", size), models, ["k"]).collect()}
        for k, model in MODELS.items():
            m = batch(model)
            gamma, pairs, ll = M.expectation(x[k], m)
            gamma, pairs = gamma[:, 0], pairs[..., 0]
            mu = gamma @ x[k] / gamma.sum(1)
            np.testing.assert_allclose(got[k].pi, gamma[:, 0], atol=1e-9)
            np.testing.assert_allclose(got[k].a, pairs / pairs.sum(1, keepdims=True), atol=1e-9)
            np.testing.assert_allclose(got[k].mu, mu, atol=1e-9)
            np.testing.assert_allclose(got[k].sigma, np.sqrt((gamma * (x[k] - mu[:, None]) ** 2).sum(1) / gamma.sum(1)), atol=1e-8)
            assert got[k].ll == pytest.approx(ll[0])


def test_fit_climbs(spark, series, models):
    _, rows = series
    blocks = S.series_blocks(rows, ["k"], "v", "t", 40)
    start = {r.k: r.ll for r in S.chain_loglik(blocks, models, ["k"]).collect()}
    one, three = ({r.k: r for r in S.fit(blocks, models, ["k"], n).collect()} for n in (1, 3))
    assert all(start[k] < one[k].ll < three[k].ll for k in start)
    assert {r.rounds for r in three.values()} == {3}
    again = S.chain_loglik(blocks, S.fit(blocks, models, ["k"], 1), ["k"]).collect()
    assert {r.k: r.ll for r in again} == pytest.approx({k: r.ll for k, r in one.items()})


def test_recurrence(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, None if rng.random() < 0.1 else float(rng.normal()), None if rng.random() < 0.1 else float(rng.uniform(-1, 1))) for k in (1, None) for i in range(83)]
    table = spark.createDataFrame(rows, "k int, i int, a double, b double")
    want, h = {}, {}
    for k, i, a, b in rows:
        h[k] = (a or 0.0) + (1.0 if b is None else b) * h.get(k, 2.0)
        want[k, i] = h[k]
    for size in (1, 10, 1000):
        assert {(r.k, r.i): r.h for r in S.recurrence(table, ["k"], "i", "a", "b", 2.0, "h", size).collect()} == pytest.approx(want)


def test_marks_sums_and_segments(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.choice([None, None, 1, 2, 3])) for k in (1, 2) for i in range(70)]
    table = spark.createDataFrame(rows, "k int, i int, v int")
    p = pd.DataFrame(rows, columns=["k", "i", "v"])
    g = p.groupby("k").v
    p["back"], p["ahead"] = g.transform(lambda s: s.ffill().shift(1)), g.transform(lambda s: s.bfill().shift(-1))
    p["total"] = g.transform(lambda s: s.fillna(0).cumsum())
    p["segment"] = g.transform(lambda s: (s.fillna(-1) != s.fillna(-1).shift(1)).cumsum())
    for size in (1, 6, 1000):
        r = S.carried(table, ["k"], "i", {"back": F.col("v")}, {"ahead": F.col("v")}, {"total": F.col("v")}, size)
        r = S.segments(r, ["k"], "i", F.col("v"), "segment", size)
        got = r.select(*p.columns).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(got.astype(float), p.astype(float), check_dtype=False)


def test_rows_around(spark):
    table = spark.range(50).select(F.lit("x").alias("k"), F.col("id").alias("i"))
    for size, behind, ahead in ((7, 3, 2), (4, 9, 0), (100, 5, 5), (1, 2, 2)):
        by = {}
        for r in S.overlapped(table, ["k"], "i", behind, ahead, size).collect():
            by.setdefault(r._in, []).append((r.i, r._block))
        for b, rows in by.items():
            own = [i for i, own in rows if own == b]
            low, high = b * size, min(49, b * size + size - 1)
            assert sorted(own) == list(range(low, high + 1)) if low <= 49 else not own
            assert sorted(i for i, _ in rows) == list(range(max(0, low - behind), min(49, low + size - 1 + ahead) + 1))


def test_no_window_holds_a_series(spark):
    """Windows of the operators on runs and eras are within blocks, or over a row per block."""
    rows = spark.createDataFrame([("a", 1, 1.0)], "k string, i long, v double")
    for made in (I.trailing(rows, ["k"], "i", "v"), I.median_filter(rows, ["k"], "i", "v"), I.index_windows(rows, ["k"], "i", 2, 1), S.carried(rows, ["k"], "i", {"x": F.col("v")})):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        for line in (x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Window")):
            assert "_block" in line or "_stretch" in line or "_in" in line


def test_empty_tables(spark, models):
    none = spark.createDataFrame([], "k string, t int, v double")
    assert S.chain_states(none, models, ["k"], "v", "t").count() == S.likely_path(none, models, ["k"], "v", "t").count() == 0
    assert S.recurrence(none.withColumn("b", F.lit(1.0)), ["k"], "t", "v", "b").count() == 0
    assert S.carried(none, ["k"], "t", {"x": F.col("v")}).count() == S.segments(none, ["k"], "t", F.col("v")).count() == 0
