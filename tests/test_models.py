"""Models on simulated series, and streams against their batch results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import markov as M, stats as T, switching as W

A = np.array([[0.95, 0.05], [0.1, 0.9]])
MU, SIGMA = np.array([0.0, 1.0]), np.array([0.5, 2.0])


def path(t, seed):
    return M.simulated(A, MU, SIGMA, t, [seed])[0]


def table(spark, x):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "key int, t int, v double")
    return M.as_arrays(rows, ["key"], "v", "t")


@pytest.fixture(scope="module")
def series(spark):
    return table(spark, path(600, 3))


def batch(*models):
    return tuple(np.stack(p, -1) for p in zip(*models, strict=True))


def slow_passes(x, pi, a, mu, sigma):
    """Causal and two-sided probabilities, expected transitions and log-likelihood by summing over all paths' logarithms."""
    k, t = len(pi), len(x)
    log_b = np.array([[-0.5 * ((v - mu[s]) / sigma[s]) ** 2 - np.log(sigma[s]) - 0.5 * np.log(2 * np.pi) for s in range(k)] for v in x])
    f, g = np.empty((t, k)), np.zeros((t, k))
    f[0] = np.log(pi) + log_b[0]
    for i in range(1, t):
        f[i] = [np.logaddexp.reduce(f[i - 1] + np.log(a[:, s])) + log_b[i, s] for s in range(k)]
    for i in range(t - 2, -1, -1):
        g[i] = [np.logaddexp.reduce(np.log(a[r]) + log_b[i + 1] + g[i + 1]) for r in range(k)]
    ll = np.logaddexp.reduce(f[-1])
    pairs = sum(np.exp(f[i][:, None] + np.log(a) + log_b[i + 1] + g[i + 1] - ll) for i in range(t - 1))
    return np.exp(f - np.logaddexp.reduce(f, axis=1)[:, None]), np.exp(f + g - ll), pairs, ll


@pytest.mark.parametrize("t", [1, 2, 3, 50, 101])
def test_block_products_match_logarithms(t):
    x, g = path(t, 1), np.random.default_rng(t)
    for k in (2, 3):
        models = [(g.dirichlet(np.ones(k)), g.dirichlet(np.ones(k), k), g.normal(size=k), g.uniform(0.3, 2, k)) for _ in range(3)]
        m = batch(*models)
        alpha, ll, _ = M.filtered(x, m)
        gamma, pairs, again = M.expectation(x, m)
        for i, one in enumerate(models):
            want = slow_passes(x, *one)
            for got, w in zip((alpha[:, i].T, gamma[:, i].T, pairs[..., i], ll[i]), want):
                assert np.allclose(got, w, atol=1e-9)
            assert again[i] == pytest.approx(want[3])


def test_scores_are_slopes_of_the_likelihood():
    x, m = path(80, 2), batch((np.array([0.4, 0.6]), A, MU, SIGMA))
    slope, visits = M.scores(x, m)
    for i in (0, 1):
        for j in (0, 1):
            up, down = m[1].copy(), m[1].copy()
            up[i, j] += 1e-6
            down[i, j] -= 1e-6
            assert slope[i, j, 0] == pytest.approx((M.loglik(x, (m[0], up, *m[2:]))[0] - M.loglik(x, (m[0], down, *m[2:]))[0]) / 2e-6, rel=1e-4)
    assert visits.sum() == pytest.approx(79)


def test_em_climbs_and_stops(series):
    x = path(300, 4)
    start = M.drawn(x, 2, range(5), 1)
    seen = M.em(x, start, 60, 0.0, looks=(1, 5, 20, 60))[4]
    assert all((seen[b] >= seen[a] - 1e-9).all() for a, b in ((1, 5), (5, 20), (20, 60)))
    m, ll, n, stopped, _ = M.em(x, start, 5000, 1e-9, step_tol=1e-8)
    assert stopped.all() and (n < 5000).all() and np.allclose(ll, M.loglik(x, m))
    for i in range(5):  # members do not touch each other
        alone = M.em(x, M.take(start, [i]), 5000, 1e-9, step_tol=1e-8)
        assert alone[1][0] == pytest.approx(ll[i], abs=1e-6) and alone[2][0] == n[i]


def test_fit_recovers_the_chain(spark, series):
    fits = M.fit(series, ["key"], (2,), 4, 200, 1e-6, kinds=("random", "spread"))
    best = M.best(fits, ["key"]).first()
    assert best.sigma == pytest.approx(SIGMA.tolist(), abs=0.25)
    assert best.a[0][0] == pytest.approx(0.95, abs=0.05)
    assert sum(r.starts for r in M.optima(fits, ["key"]).collect()) == 8
    assert sum(r.starts for r in M.reached(fits, ["key"]).collect()) == 8
    chunked = M.fit(series, ["key"], (2,), 4, 200, 1e-6, chunk=1).select("start", F.round("ll", 6)).collect()
    assert sorted(chunked) == sorted(fits.where("kind = 'random'").select("start", F.round("ll", 6)).collect())


def test_split_starts_have_a_state_more(spark, series):
    parent = M.best(M.fit(series, ["key"], (2,), 2, 200), ["key", "k"])
    wide = M.fit_wide(series, ["key"], 3, 2, 2, parent, rounds=150)
    rows = wide.collect()
    assert len(rows) == 2 + 2 + 6 and {r.kind for r in rows} == {"random", "spread", "split"}
    assert all(len(r.mu) == 3 and r.sigma == sorted(r.sigma) for r in rows)
    assert all(abs(sum(row) - 1) < 1e-9 for r in rows for row in r.a)
    assert max(r.ll for r in rows if r.kind == "split") >= parent.first().ll - 1e-6


def test_transitions_from_their_diagonal():
    a = np.array([[0.9, 0.06, 0.04], [0.2, 0.7, 0.1], [0.0, 0.3, 0.7]])
    assert np.allclose(M.from_diagonal(np.diag(a), M.stationary(a), (2, 0)), a)


def test_protocol_and_progress(spark, series):
    row = M.protocol(series, ["key"], (2,), 3, 3000, 1e-6, step_tol=1e-6).first()
    assert row.k == 2 and row.ll >= M.best(M.fit(series, ["key"], (2,), 3, 3000), ["key"]).first().ll - 1e-6
    rows = M.progress(series, ["key"], 2, 3, (1, 10, 50)).collect()
    assert len(rows) == 9 and all(r.left >= -1e-6 for r in rows)


def test_states_and_residuals(spark, series):
    best = M.best(M.fit(series, ["key"], (2,), 2, 100), ["key"])
    rows = M.states(series, best, ["key"])
    assert rows.count() == 600
    assert rows.where(F.abs(F.get("smoothed", F.lit(0)) + F.get("smoothed", F.lit(1)) - 1) > 1e-9).count() == 0
    z = M.residuals(rows).agg(F.avg("z"), F.var_samp("z"), F.count("z")).first()
    assert abs(z[0]) < 0.15 and z[1] == pytest.approx(1, abs=0.3) and z[2] == 599


def test_bootstrap_does_not_depend_on_partitions(spark, series):
    best = M.best(M.fit(series, ["key"], (2,), 2, 60), ["key"])
    one = {r.rep: r.ll for r in M.bootstrap(best, ["key"], 80, 6, rounds=20, chunk=2).collect()}
    two = {r.rep: r.ll for r in M.bootstrap(best, ["key"], 80, 6, rounds=20, chunk=6).collect()}
    assert one == two and len(one) == 6


def test_bootstrap_paths_are_as_long_as_the_series(spark, series):
    best = M.best(M.fit(series, ["key"], (2,), 2, 60), ["key"])
    whole = {r.rep: r.ll for r in M.bootstrap(best, ["key"], None, 3, rounds=5).collect()}
    assert whole == {r.rep: r.ll for r in M.bootstrap(best, ["key"], 600, 3, rounds=5).collect()}


def test_bootstrap_reports(spark, series):
    best = M.best(M.fit(series, ["key"], (2,), 2, 200), ["key"])
    reps = M.bootstrap(best, ["key"], 200, 12, rounds=100, check=3, n_starts=4).cache()
    rows = M.bootstrap_summary(reps, best, ["key"]).collect()
    assert len(rows) == 16 and {r.labels for r in rows} == {"sigma", "mu"} and all(r.lo <= r["mean"] <= r.hi for r in rows)
    check = M.bootstrap_check(reps, ["key"]).first()
    assert (check.replicates, check.checked) == (12, 3) and check.short <= 3
    share = {r.value: r for r in M.power(best.withColumn("n", F.lit(150)), ["key"], (1, 0), (0.0, 0.3), 10, rounds=100).collect()}
    assert share[0.0].at_zero >= 0.8 and share[0.3].at_zero < 0.5 and share[0.3].replicates == 10


def test_model_queries_take_all_hours_of_all_venues(spark):
    from tidemark.plans import models
    from tidemark.plans.tables import hourly

    d = "/root/testdata/sf0.01"
    want = {r.venue: r["count"] for r in hourly(spark, d).groupBy("venue").count().collect()}
    got = {r.venue: r.n for r in models.series(spark, d).collect()}
    assert got == want and len(got) == 5 and min(got.values()) > 600


def test_profile_has_its_top_at_the_estimate(spark, series):
    m = M.best(M.fit(series, ["key"], (2,), 2, 2000, 1e-9), ["key"])
    at = m.first().a[0][1]
    rows = M.profile(series, m, ["key"], (0, 1), (at, at * 4, at * 8), 200)
    drops = {r.value: r.drop for r in rows.collect()}
    assert abs(drops[at]) < 0.05 and drops[at * 4] > 0.5
    bound = M.refined_bound(series, m, ["key"], (0, 1), rounds=500).first()
    back = M.profile(series, m, ["key"], (0, 1), (bound.upper,), 500).first()
    assert bound.upper > at and back["drop"] == pytest.approx(2.7055, abs=0.02) and bound.evaluated == 14 + 3 * 8
    assert M.profile_bound(rows, ["key"]).first().upper == pytest.approx(bound.upper, rel=0.5)


def test_a_transition_near_zero(spark):
    a = np.array([[0.9, 0.1, 0.0], [0.05, 0.9, 0.05], [0.0, 0.1, 0.9]])
    x = M.simulated(a, np.array([-3.0, 0.0, 3.0]), np.array([0.4, 0.6, 0.8]), 700, [8])[0]
    arrays = table(spark, x)
    m = M.best(M.fit(arrays, ["key"], (3,), 6, 3000, 1e-9), ["key"])
    zero, inside = (M.cell_estimate(arrays, m, ["key"], c).first() for c in ((0, 2), (0, 1)))
    decision = M.boundary_score(arrays, m, ["key"], (0, 2)).first()
    assert zero.at_boundary and zero.estimate == 0 and decision.at_boundary and decision.ratio <= 1
    assert not inside.at_boundary and inside.estimate == pytest.approx(m.first().a[0][1], abs=1e-3) and inside.ll_max > inside.ll_zero


def test_inverted_test_keeps_the_estimate(spark):
    arrays = table(spark, path(200, 6))
    m = M.best(M.fit(arrays, ["key"], (2,), 2, 2000, 1e-9), ["key"])
    at = m.first().a[0][1]
    got = {r.value: r for r in M.inverted_test(arrays, m, ["key"], (0, 1), (at, 0.8), 20, rounds=200).collect()}
    assert got[at].inside and not got[0.8].inside and got[at].p > got[0.8].p


# switching autoregression --------------------------------------------------------------------

THETA = np.array([0.96, 0.9, 0.0, 3.0, 0.8, 0.3, 0.25, 4.0])


def switching_path(t, seed, theta=THETA):
    g, s = np.random.default_rng(seed), 0
    y = [theta[2]]
    for _ in range(t - 1):
        r, s = s, s if g.random() < theta[s] else 1 - s
        y.append(theta[2 + s] + theta[4 + s] * (y[-1] - theta[2 + r]) + np.sqrt(theta[6 + s]) * g.standard_normal())
    return np.array(y)


def slow_switching_loglik(theta, y):
    """Over the four pairs of regimes, one at a time."""
    p = {(0, 0): theta[0], (0, 1): 1 - theta[0], (1, 0): 1 - theta[1], (1, 1): theta[1]}
    now = {0: (1 - theta[1]) / (2 - theta[0] - theta[1])}
    now[1], total = 1 - now[0], 0.0
    for t in range(1, len(y)):
        new = {0: 0.0, 1: 0.0}
        for (r, s), q in p.items():
            e = y[t] - theta[2 + s] - theta[4 + s] * (y[t - 1] - theta[2 + r])
            new[s] += now[r] * q * np.exp(-e * e / (2 * theta[6 + s])) / np.sqrt(2 * np.pi * theta[6 + s])
        size = new[0] + new[1]
        total += np.log(size)
        now = {s: v / size for s, v in new.items()}
    return total


def test_switching_likelihood_is_that_of_the_pairs():
    y = switching_path(120, 1)
    other = np.array([0.8, 0.7, 0.5, 2.0, 0.5, -0.2, 1.0, 2.0])
    assert W.loglik(np.stack([THETA, other], 1), y) == pytest.approx([slow_switching_loglik(THETA, y), slow_switching_loglik(other, y)])


def test_switching_em_climbs_to_a_maximum():
    y = switching_path(500, 2)
    theta, last = W.drawn(y, range(6), 1), np.full(6, -np.inf)
    for _ in range(40):
        theta, ll = W.improved(theta, y, 1e-9)
        assert (ll >= last - 1e-3).all()
        last = ll
    theta, ll, _ = W.fit_members(W.drawn(y, range(6), 1), y, 5000, 1e-10)
    score, hess = W.derivatives(theta[:, ll.argmax()], y)
    assert np.abs(score.sum(0)).max() < 0.02 and (np.linalg.eigvalsh(hess) < 0).all()


def test_switching_fit(spark):
    arrays = table(spark, switching_path(900, 5))
    fits = W.fit_switching(arrays, ["key"], 8, 3000)
    best = W.best_switching(fits, ["key"])
    r = best.first()
    assert [r[n] for n in W.NAMES] == pytest.approx(THETA.tolist(), abs=0.6) and r.phi0 == pytest.approx(0.8, abs=0.1)
    inferred = W.inference(arrays, best, ["key"]).cache()
    report = {x.covariance: x for x in W.ratio_report(inferred).collect()}
    assert set(report) == {"hessian", "opg", "sandwich"}
    h = report["hessian"]
    assert h.half_life0 > h.half_life1 and h.wald.side == "above" and h.sets.ratio == pytest.approx(h.half_life0 / h.half_life1)
    assert h.sets.linear.lo < h.sets.ratio < h.sets.linear.hi and h.sets.log.lo > 0 and h.switching_side == "above"
    delta = {x.covariance: x for x in W.switching_delta(inferred, ["key"]).collect()}["hessian"]
    drawn = {x.covariance: x for x in W.simulated_ratio(inferred, ["key"], 4000).collect()}["hessian"]
    assert drawn.draws == 4000 and drawn.lo < delta.ratio < drawn.hi and drawn.lo_hours <= drawn.hi_hours
    assert delta.half_life0 == pytest.approx(W.switching_half_life(r.p00, r.p11, r.phi0, r.phi1, 0))
    share = W.influence(arrays, best, ["key"]).agg(F.sum("share"), F.count("*"), F.min("share")).first()
    assert share[0] == pytest.approx(1) and share[1] == 899 and share[2] >= 0
    z = W.residuals(arrays, best, ["key"]).agg(F.avg("z"), F.var_samp("z"), F.count("*")).first()
    assert abs(z[0]) < 0.15 and z[1] == pytest.approx(1, abs=0.25) and z[2] == 898
    blocks = W.seed_blocks(arrays, ["key"], 2, 3, rounds=500).collect()
    assert len(blocks) == 2 and all(b.ll <= r.ll + 0.05 for b in blocks)
    assert sum(x.starts for x in W.optima_histogram(fits, ["key"]).collect()) == 8


@pytest.mark.parametrize("p", [(0.9, 0.8, 0.7, 0.2), (0.5, 0.5, 0.9, 0.9), (0.1, 0.2, 0.8, -0.7), (0.7, 0.6, 0.5, 0.5)])
def test_decay_by_folding_and_by_eigenvalues(spark, p):
    m = spark.createDataFrame([(1, *p)], "key int, p00 double, p11 double, phi0 double, phi1 double")
    rows = W.decay(m, ["key"], 30).collect()
    kernel = np.array([[p[0], 1 - p[0]], [1 - p[1], p[1]]]) * np.array(p[2:])
    for r in rows:
        want = np.linalg.matrix_power(kernel, r.hour)[r.start_state].sum()
        assert r.left == pytest.approx(want, abs=1e-12) and r.closed == pytest.approx(want, abs=1e-9)
    for start in (0, 1):
        left = {r.hour: r.left for r in rows if r.start_state == start}
        half = W.switching_half_life(*p, start)
        assert left[int(half)] >= 0.5 >= left[int(np.ceil(half))] if np.isfinite(half) and half < 30 else min(left.values()) > 0.5


def test_chains_that_do_not_halve():
    hours, exact, left = W.halving(np.array([[1.0], [0.5]]), np.array([[1.0], [0.0]]), most=50)
    assert hours[0, 0] == exact[0, 0] == np.inf and left[0, 0] == 1 and hours[1, 0] == 1 and np.isnan(left[1, 0])


def test_garch_variance_is_the_recursion():
    e = np.random.default_rng(1).normal(size=333)
    h = [2.0]
    for v in e[:-1]:
        h.append(0.1 + 0.2 * v * v + 0.75 * h[-1])
    assert np.allclose(W.garch_variance(e, 0.1, 0.2, 0.75, 2.0), h)


def test_garch_fit(spark):
    x = W.simulate_garch(0.0, 0.1, 0.1, 0.8, 1500, np.random.default_rng(2))
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "key int, t int, v double")
    r = W.fit_garch(M.as_arrays(rows, ["key"], "v", "t"), ["key"], ("normal",), 1.0).first()
    assert r.alpha + r.beta == pytest.approx(0.9, abs=0.12)


def test_chains_on_paths_without_states(spark):
    g = spark.createDataFrame([(1, "normal", 0.0, 1.0, 0.0, 0.0, None, 250), (2, "normal", 0.0, 0.02, 0.3, 0.69, None, 600)], "key int, dist string, mu double, omega double, alpha double, beta double, nu double, n long")
    got = {(r.key, r.k): r for r in W.chains_on_garch(g, ["key"], (1, 2), 6, 2, 300, chunk=2).collect()}
    assert all(r.paths == 6 for r in got.values()) and got[1, 1].preferred + got[1, 2].preferred == 6
    assert got[1, 1].preferred >= 5 and got[2, 2].preferred >= 4  # plain noise, and strong clustering


def test_garch_loss_far_out():
    x = W.simulate_garch(0.0, 0.1, 0.1, 0.8, 50, np.random.default_rng(2))
    assert np.isfinite(W.garch_loss([0.0, 0.0, -800.0, -800.0], x, False))


def test_arch_lm_and_bootstrap(spark):
    x = np.random.default_rng(8).standard_normal(500)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "key int, t int, v double")
    y = x[12:] ** 2
    m = np.column_stack([np.ones(len(y)), *(x[12 - k : -k] ** 2 for k in range(1, 13))])
    e = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
    r = T.arch_lm(rows, ["key"], "v", "t").first()
    assert r.n == 488 and r.lm == pytest.approx(488 * (1 - (e @ e) / ((y - y.mean()) ** 2).sum()))
    b = T.block_bootstrap_median(rows, ["key"], "v", "t", 24, 200).first()
    assert b.lo < b["median"] < b.hi and b["median"] == pytest.approx(float(np.median(x)))


def test_streams_match_batches(spark, tmp_path):
    from tidemark.streaming import funding as S

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "ts", "value")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = {}
    for name, plan, mode in (("share", S.floor_share(S.records(stream), late="90 days"), "complete"), ("bars", S.hourly_bars(S.records(stream), late="90 days"), "complete"), ("states", S.state_filter(S.records(stream), [0.5, 0.5], A, [0.0, 3.0], [1.0, 6.0]), "append")):
        q = plan.writeStream.format("memory").queryName(f"t_{name}").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        out[name] = spark.table(f"t_{name}")
    assert out["share"].agg(F.sum("n")).first()[0] == events.count()
    batch = S.records(events).agg(F.count_if(F.col("r") == 1000)).first()[0]
    assert out["share"].agg(F.sum("at_floor")).first()[0] == batch
    assert out["bars"].agg(F.sum("n")).first()[0] == events.count()
    assert out["states"].count() == events.count()
    assert out["states"].where(F.abs(F.get("probabilities", F.lit(0)) + F.get("probabilities", F.lit(1)) - 1) > 1e-9).count() == 0
