"""Quantiles, ranks and resampled medians by counting against sorted values."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection as S

PROBS = (0.0, 0.0005, 0.25, 0.5, 0.77, 0.99, 1.0)


def columns():
    rng = np.random.default_rng(1)
    skewed = np.exp(rng.normal(0, 6, 30_000))
    return {
        "skewed": skewed, "repeated": rng.choice([0.0, 0.0, 0.0, 1.0, 5.5], 20_000), "one": np.array([3.25]), "two": np.array([1.0, 2.0]), "equal": np.full(1000, -7.0),
        "outlier": np.append(rng.normal(0, 1e-9, 5000), 1e300), "few": np.arange(7.0), "steps": np.repeat(np.arange(300.0), rng.integers(1, 40, 300)),
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in columns().items()] + [pd.DataFrame({"k": ["skewed", "none"], "v": [None, None]})])
    return spark.createDataFrame(rows, "k string, v double").withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(8)


def test_quantiles_are_exact(table):
    want = {r.k: r.q for r in table.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect()}
    for rounds in (0, 1, 2):
        got = {r.k: r for r in S.quantiles(table, ["k"], "v", PROBS, rounds).collect()}
        assert set(got) == set(columns())
        for k, v in columns().items():
            assert got[k].n == len(v)
            assert got[k].q == pytest.approx(want[k], rel=1e-12), (k, rounds)
    whole = S.quantiles(table.where("k = 'steps'"), [], "v", (0.3,)).collect()
    assert whole[0].q[0] == pytest.approx(np.quantile(columns()["steps"], 0.3))
    assert S.quantiles(table.limit(0), ["k"], "v", PROBS).count() == 0


def test_what_is_left_to_order_is_little(table):
    """After two rounds the values to be ordered are a small share of the rows, unless they are equal."""
    given = columns()["skewed"]
    edges = np.quantile(given, [0.5 - 3 / 256, 0.5 + 3 / 256])
    assert ((given >= edges[0]) & (given <= edges[1])).mean() < 0.03


def test_ranks_and_correlations(spark, table):
    got = S.value_ranks(table, ["k"], "v").toPandas()
    for k, v in columns().items():
        want = pd.DataFrame({"v": v, "r": pd.Series(v).rank()}).drop_duplicates().sort_values("v")
        own = got[got.k == k].sort_values("v")
        assert own.v.tolist() == want.v.tolist() and own["rank"].tolist() == want.r.tolist() and own.c.sum() == len(v)
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"k": rng.choice(["a", "b"], 4000), "x": rng.integers(0, 30, 4000).astype(float)})
    p["y"] = np.exp(p.x / 7) + rng.normal(0, 3, 4000)
    got = S.correlations(spark.createDataFrame(p), ["k"], "x", "y").toPandas().set_index("k")
    for k, g in p.groupby("k"):
        assert got.n[k] == len(g)
        assert got.pearson[k] == pytest.approx(g.x.corr(g.y), abs=1e-12) and got.spearman[k] == pytest.approx(g.x.rank().corr(g.y.rank()), abs=1e-12)
    flat = S.correlations(spark.createDataFrame([("a", 1.0, 2.0)] * 3, "k string, x double, y double"), ["k"], "x", "y").first()
    assert (flat.n, flat.pearson, flat.spearman) == (3, None, None)


@pytest.mark.parametrize(("n", "block"), [(1, 24), (10, 24), (100, 24), (97, 10), (50, 1)])
def test_medians_of_replicates(spark, n, block):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(0, 1, n), 1)
    rows = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)] + [("s", n, None)], "k string, t long, v double")
    got = {r.rep: r.median for r in S.bootstrap_medians(rows, ["k"], "v", "t", block, 20, seed=5).collect()}
    width = min(block, n)
    for r in range(20):
        starts = [int(hashlib.md5(f"5:{r}:{j}".encode()).hexdigest()[:8], 16) % (n - width + 1) for j in range(-(-n // width))]
        drawn = np.concatenate([x[s : s + width] for s in starts])[:n]
        assert got[r] == pytest.approx(np.median(drawn)), r


def test_interval_is_near_that_of_arrays(spark):
    from tidemark.operators.stats import block_bootstrap_median

    x = np.random.default_rng(8).normal(0, 1, 400)
    rows = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, t long, v double")
    a = S.bootstrap_interval(rows, ["k"], "v", "t", 24, 400).first()
    b = block_bootstrap_median(rows, ["k"], "v", "t", 24, 400).first()
    assert a.n == b.n == 400 and a.median == pytest.approx(b.median)
    assert abs(a.lo - b.lo) < 0.06 and abs(a.hi - b.hi) < 0.06
