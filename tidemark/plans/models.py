"""Queries that fit models: a Gaussian chain, a switching AR(1), GARCH, and what follows from the fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import islands as I, markov as M, stats as T, switching as W
from tidemark.plans.tables import hourly, rounded

# The reference's counts.
STARTS, SELECTION_STARTS, SELECTION_KS = 8, 40, (2, 3, 4, 5)
CAP, TOL = 100_000, 1e-6  # rounds of EM are stopped by the tolerance
SEARCH_TOL, POLISH_TOL = 1e-3, 1e-8  # of the selection: all starts are searched, the best of each number of states is polished
REPS, BOOT_CAP, BOOT_TOL = 500, 400, 1e-6
POWER_REPS, ALTERNATIVES = 200, (0.003, 0.01)
SWITCHING_STARTS, SEED_BLOCKS, DRAWS = 40, 6, 50_000
CELL = (1, 0)  # from the wide state to the calm one
ROLL, STEP = 480, 120  # hours of a rolling window and between windows


def rows(spark, d):
    """(venue, time, v): hourly mean premiums in bps."""
    return hourly(spark, d).select("venue", "time", (F.col("m") / 1000.0).alias("v"))


def series(spark, d):
    """(venue, n, x): each venue's whole series."""
    return M.as_arrays(rows(spark, d), ["venue"], "v", "time")


def fits(spark, d, ks=(2,), starts=STARTS, kinds=("random",)):
    return M.fit(series(spark, d), ["venue"], ks, starts, CAP, TOL, kinds=kinds)


def best(spark, d):
    return M.best(fits(spark, d), ["venue", "k"])


def hmm_fits(spark, d):
    return rounded(fits(spark, d, kinds=("random", "spread")), "ll", digits=4)


def hmm_optima(spark, d):
    return M.optima(fits(spark, d), ["venue", "k"])


def hmm_wide(spark, d):
    """Three states from random and spread starts and from splits of the best two: how many of each family reach the best."""
    s = series(spark, d)
    return M.reached(M.fit_wide(s, ["venue"], 3, STARTS, STARTS, best(spark, d), CAP, TOL), ["venue"])


def hmm_selection(spark, d):
    return M.selection(M.protocol(series(spark, d), ["venue"], SELECTION_KS, SELECTION_STARTS, CAP, SEARCH_TOL, POLISH_TOL, None), ["venue"])


def hmm_polish(spark, d):
    return M.protocol(series(spark, d), ["venue"], (2,), STARTS, CAP).select("venue", "k", "ll", M.durations().alias("durations"), "mu", "sigma")


def hmm_progress(spark, d):
    """What starts still gain after the rounds at which other protocols stop."""
    return M.progress(series(spark, d), ["venue"], 2, STARTS, (50, 200, 400, 2000)).groupBy("venue", "round").agg(F.max("ll").alias("best"), F.max("left").alias("most_left"), F.count_if(F.col("left") < 1e-6).alias("done"))


def hmm_states(spark, d):
    return M.states(series(spark, d), best(spark, d), ["venue"])


def hmm_residuals(spark, d):
    z = M.residuals(hmm_states(spark, d))
    return z.groupBy("venue").agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.var_samp("z").alias("var"), F.kurtosis("z").alias("excess_kurtosis"))


def hmm_bootstrap(spark, d):
    m = best(spark, d)
    return M.bootstrap_summary(M.bootstrap(m, ["venue"], None, REPS, rounds=BOOT_CAP, tol=BOOT_TOL), m, ["venue"])


def hmm_bootstrap_check(spark, d):
    return M.bootstrap_check(M.bootstrap(best(spark, d), ["venue"], None, REPS, rounds=BOOT_CAP, tol=BOOT_TOL, check=20, n_starts=STARTS), ["venue"])


def hmm_power(spark, d):
    return M.power(best(spark, d), ["venue"], CELL, ALTERNATIVES, POWER_REPS, rounds=BOOT_CAP, tol=BOOT_TOL)


def hmm_profile(spark, d):
    s, m = series(spark, d), best(spark, d)
    p = M.profile(s, m, ["venue"], CELL, M.GRID)
    return p.join(M.refined_bound(s, m, ["venue"], CELL).select("venue", "estimate", "upper"), "venue", "left")


def hmm_inverted(spark, d):
    return M.inverted_test(series(spark, d), best(spark, d), ["venue"], CELL, (0.05, 0.2, 0.5, 0.8), POWER_REPS, rounds=BOOT_CAP, tol=BOOT_TOL)


def hmm_boundary(spark, d):
    return M.boundary_score(series(spark, d), best(spark, d), ["venue"], CELL)


def hmm_cell(spark, d):
    return M.cell_estimate(series(spark, d), best(spark, d), ["venue"], CELL)


def regimes(spark, d):
    return W.fit_switching(series(spark, d), ["venue"], SWITCHING_STARTS)


def switching_fits(spark, d):
    return W.admissible(regimes(spark, d))


def switching_best(spark, d):
    return W.best_switching(regimes(spark, d), ["venue"])


def switching_optima(spark, d):
    return W.optima_histogram(regimes(spark, d), ["venue"])


def switching_seeds(spark, d):
    return W.seed_blocks(series(spark, d), ["venue"], SEED_BLOCKS, SWITCHING_STARTS)


def inferred(spark, d):
    return W.inference(series(spark, d), switching_best(spark, d), ["venue"])


def switching_ratio(spark, d):
    return W.ratio_report(inferred(spark, d))


def switching_delta(spark, d):
    return W.switching_delta(inferred(spark, d), ["venue"])


def switching_draws(spark, d):
    return W.simulated_ratio(inferred(spark, d), ["venue"], DRAWS)


def switching_decay(spark, d):
    return W.decay(switching_best(spark, d), ["venue"])


def switching_influence(spark, d):
    """The three hours of each venue with the largest share of the sandwich variance of the half-lives' ratio."""
    from pyspark.sql import Window

    shares = W.influence(series(spark, d), switching_best(spark, d), ["venue"])
    return shares.withColumn("rank", F.row_number().over(Window.partitionBy("venue").orderBy(F.desc("share"), "t"))).where("rank <= 3")


def switching_residuals(spark, d):
    return W.residuals(series(spark, d), switching_best(spark, d), ["venue"])


def labelled(arrays, keys):
    """Half-lives and their ratio of the best fit of each series."""
    m = W.best_switching(W.fit_switching(arrays, keys, SWITCHING_STARTS), keys)
    return W.ratio_report(W.inference(arrays, m, keys)).where("covariance = 'hessian'").select(*keys, "half_life0", "half_life1", "sets.ratio", "sets.linear", "wald")


def switching_rolling(spark, d):
    windows = I.index_windows(rows(spark, d), ["venue"], "time", ROLL, STEP)
    return labelled(M.as_arrays(windows, ["venue", "window"], "v", "time"), ["venue", "window"])


def switching_sensitivity(spark, d):
    variants = T.sensitivity_variants(rows(spark, d), ["venue"], "v", "time")
    return labelled(M.as_arrays(variants, ["venue", "variant"], "v", "time"), ["venue", "variant"])


def switching_upper_tail(spark, d):
    variants = T.upper_tail_variants(rows(spark, d), ["venue"], "v", "time", "2024-01-10", "2024-01-20")
    return labelled(M.as_arrays(variants, ["venue", "variant"], "v", "time"), ["venue", "variant"])


def garch(spark, d):
    return W.fit_garch(series(spark, d), ["venue"], ("normal", "t"), 1.0)


def model_ranking(spark, d):
    """Five models of each venue's hours by BIC: one Gaussian, chains of two and three states, GARCH with normal and t errors."""
    from pyspark.sql import Window

    one = T.gaussian_fit(rows(spark, d), ["venue"], "v").select("venue", F.lit("gaussian").alias("model"), F.col("loglik").alias("ll"), F.lit(2).alias("parameters"), "n")
    chains = M.best(fits(spark, d, (2, 3)), ["venue", "k"]).select("venue", F.concat(F.lit("chain_"), F.col("k").cast("string")).alias("model"), "ll", (F.col("k") * F.col("k") + 2 * F.col("k") - 1).alias("parameters"), "n")
    g = garch(spark, d).select("venue", F.concat(F.lit("garch_"), "dist").alias("model"), "ll", F.when(F.col("dist") == "t", 5).otherwise(4).alias("parameters"), "n")
    all_ = one.unionByName(chains).unionByName(g)
    bic = F.col("parameters") * F.ln("n") - 2 * F.col("ll")
    return all_.withColumns({"aic": 2 * F.col("parameters") - 2 * F.col("ll"), "bic": bic}).withColumn("rank", F.row_number().over(Window.partitionBy("venue").orderBy("bic", "model")))


def residual_battery(spark, d):
    """Tests of the standardised residuals of the two-state chain and of the switching autoregression."""
    chain_z = M.residuals(hmm_states(spark, d)).select("venue", F.lit("chain").alias("model"), "t", "z")
    ar_z = switching_residuals(spark, d).select("venue", F.lit("switching").alias("model"), F.col("t").cast("long").alias("t"), "z")
    return T.residual_battery(chain_z.unionByName(ar_z), ["venue", "model"], "z", "t")


QUERIES = {f.__name__: (f, None) for f in (
    hmm_fits, hmm_optima, hmm_wide, hmm_selection, hmm_polish, hmm_progress, hmm_states, hmm_residuals, hmm_bootstrap, hmm_bootstrap_check, hmm_power, hmm_profile, hmm_inverted, hmm_boundary, hmm_cell,
    switching_fits, switching_best, switching_optima, switching_seeds, switching_ratio, switching_delta, switching_draws, switching_decay, switching_influence, switching_residuals, switching_rolling, switching_sensitivity, switching_upper_tail,
    garch, model_ranking, residual_battery,
)}
