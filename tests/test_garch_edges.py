"""Series with thin tails have no best nu: the search may end anywhere far out, and keeps its row."""

import numpy as np

from tidemark.operators import markov as M, switching as W


def test_thin_tails_do_not_end_the_fit(spark):
    draws = {1: np.random.default_rng(1).uniform(-1, 1, 720), 2: np.random.default_rng(1).uniform(-1, 1, (720, 12)).mean(1)}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in draws.items() for i, v in enumerate(x)], "key int, t int, v double")
    got = {(r.key, r.dist): r for r in W.fit_garch(M.as_arrays(rows, ["key"], "v", "t"), ["key"], ("normal", "t"), 1.0).collect()}
    assert set(got) == {(k, d) for k in draws for d in ("normal", "t")}
    for r in got.values():
        assert np.isfinite([r.ll, r.mu, r.omega, r.alpha, r.beta]).all() and r.n == 720
    assert all(2 < got[k, "t"].nu <= 2 + np.exp(10) and abs(got[k, "t"].ll - got[k, "normal"].ll) < 1 for k in draws)
    short = W.fit_garch(M.as_arrays(rows.where("t < 200"), ["key"], "v", "t"), ["key"], ("t",), 1.0)
    assert {(r.key, r.k) for r in W.chains_on_garch(short, ["key"], (1, 2), 2, 2, 50).collect()} == {(k, s) for k in draws for s in (1, 2)}


def test_every_end_of_a_search_is_a_model():
    x = np.random.default_rng(2).normal(size=50)
    for far in (-1e4, -800.0, -40.0, 40.0, 800.0, 1e4):
        for free in ([0.0, far, 1.0, -1.0, 1.0], [0.0, 0.0, far, -1.0, 1.0], [0.0, 0.0, 1.0, far, 1.0], [0.0, 0.0, 1.0, -1.0, far]):
            mu, omega, alpha, beta, nu = W.garch_parameters(free, True)
            assert np.isfinite([mu, omega, alpha, beta, nu]).all() and nu > 2 and alpha + beta <= 1
            assert np.isfinite(W.garch_loss(free, x, True))
