"""Mean-adjusted two-regime switching AR(1), half-lives under switching, and GARCH(1,1): a row per fit.

y[t] - mu[s] = phi[s] (y[t-1] - mu[r]) + e with variance var[s], s the regime of t and r that of
t - 1. So the density of a time depends on the pair of regimes, and the chain's step from r to s
carries it. Regimes are numbered by variance, the calm one first. Series go to tasks as arrays,
starts and replicates are stepped together, times in blocks (see ``chain``).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import chain
from tidemark.operators.markov import chunks, each_row, key_schema, numbers, spread

NAMES = ("p00", "p11", "mu0", "mu1", "phi0", "phi1", "var0", "var1")
FIT = "start int, ll double, " + ", ".join(f"{n} double" for n in NAMES) + ", regular boolean, spread double, rounds int, n long"
Z95 = 1.959963984540054


# kernels: parameters are (8, members) in the order of NAMES ------------------------------------


def transitions(theta: np.ndarray) -> np.ndarray:
    """(from, to, members)."""
    return np.array([[theta[0], 1 - theta[0]], [1 - theta[1], theta[1]]])


def steps_of(theta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from, to, members, T-1) divided by the largest density of each time, and the logs of those divisors."""
    mu, phi, var = theta[2:4], theta[4:6], theta[6:8]
    level = mu[None] - phi[None] * mu[:, None]  # mu of the regime less phi times mu of the one before
    e = y[1:] - level[..., None] - phi[None, ..., None] * y[:-1]
    log = -0.5 * (np.log(2 * np.pi * var)[None, ..., None] + e * e / var[None, ..., None])
    top = log.max((0, 1))
    return transitions(theta)[..., None] * np.exp(log - top), top


def law(theta: np.ndarray) -> np.ndarray:
    """The chain's stationary law (2, members)."""
    return np.array([1 - theta[1], 1 - theta[0]]) / np.maximum(2 - theta[0] - theta[1], 1e-12)


def terms(theta: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-likelihood contributions (members, T-1) of each time from the second."""
    steps, top = steps_of(theta, y)
    alpha, _ = chain.forward(law(theta), steps)
    return np.log(np.maximum(np.einsum("jrt,jirt->rt", alpha[..., :-1], steps), chain.LEAST)) + top


def loglik(theta: np.ndarray, y: np.ndarray) -> np.ndarray:
    return terms(theta, y).sum(1)


def improved(theta: np.ndarray, y: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """One round of EM: new parameters and the log-likelihoods of the old ones. Means, slopes and variances follow one after the other."""
    steps, top = steps_of(theta, y)
    alpha, log, beta = chain.both(law(theta), steps)
    _, w = chain.smoothed(alpha, beta, steps)
    new, now, before = theta.copy(), y[1:], y[:-1]
    n, sy, sx = w.sum(3), (w * now).sum(3), (w * before).sum(3)
    syy, sxx, syx = (w * now**2).sum(3), (w * before**2).sum(3), (w * (now * before)).sum(3)
    p = n / np.maximum(n.sum(1, keepdims=True), chain.LEAST)
    new[0], new[1] = p[0, 0], p[1, 1]
    phi, var = theta[4:6], theta[6:8]
    # means: weighted least squares of y - phi x on the pairs' coefficients of both means
    a, b = np.zeros((2, 2, theta.shape[1])), np.zeros((2, theta.shape[1]))
    for r in (0, 1):
        for s in (0, 1):
            c = np.zeros((2, theta.shape[1]))
            c[s] += 1
            c[r] -= phi[s]
            a += c[:, None] * c[None] * n[r, s] / var[s]
            b += c * (sy[r, s] - phi[s] * sx[r, s]) / var[s]
    det = a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]
    sure = np.abs(det) > 1e-12 * np.maximum(a[0, 0] * a[1, 1], chain.LEAST)
    safe = np.where(sure, det, 1.0)
    mu = np.where(sure, np.array([a[1, 1] * b[0] - a[0, 1] * b[1], a[0, 0] * b[1] - a[1, 0] * b[0]]) / safe, theta[2:4])
    top_phi = (syx - mu[:, None] * sy - mu[None] * sx + mu[:, None] * mu[None] * n).sum(0)
    phi = top_phi / np.maximum((sxx - 2 * mu[:, None] * sx + mu[:, None] ** 2 * n).sum(0), chain.LEAST)
    c = mu[None] - phi[None] * mu[:, None]
    rest = (syy + phi**2 * sxx + n * c**2 - 2 * phi * syx - 2 * c * sy + 2 * phi * c * sx).sum(0)
    new[2:4], new[4:6], new[6:8] = mu, phi, np.maximum(rest / np.maximum(n.sum(0), chain.LEAST), floor)
    return new, log[:, -1] + top.sum(1)


def drawn(y: np.ndarray, own, seed: int) -> np.ndarray:
    """Starts by number."""
    out = []
    for s in own:
        g = np.random.default_rng([seed, int(s)])
        stay, phi, spread = g.uniform(0.7, 0.995, 2), g.uniform(0.0, 0.98, 2), np.exp(g.uniform(-3.5, 0.7, 2))
        out.append([*stay, *g.normal(y.mean(), 0.5 * y.std() + 1e-12, 2), *phi, *np.sort(y.var() * spread)])
    return np.array(out).T


def fit_members(theta: np.ndarray, y: np.ndarray, rounds: int, tol: float, floor: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for all members at once; those that gain less than ``tol`` leave, and each is sharpened. Parameters (calm first), log-likelihoods, rounds."""
    centre, theta = y.mean(), theta.copy()
    x = y - centre
    theta[2:4] -= centre
    live, ll, n = np.arange(theta.shape[1]), np.full(theta.shape[1], -np.inf), np.zeros(theta.shape[1], int)
    for i in range(1, rounds + 1):
        new, now = improved(theta[:, live], x, floor * max(y.var(), 1e-300))
        gain, ll[live], n[live] = now - ll[live], now, i
        go = ~((gain < tol) & (i > 6))
        if not go.any():
            break
        live = live[go]
        theta[:, live] = new[:, go]
    theta = np.stack([sharpened(t, x) for t in theta.T], 1)
    ll = loglik(theta, x)
    theta[2:4] += centre
    turn = theta[6] > theta[7]
    for a in (0, 2, 4, 6):
        theta[a : a + 2, turn] = theta[a : a + 2, turn][::-1]
    return theta, ll, n


def derivatives(theta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (T-1, 8) and Hessian (8, 8) at one parameter vector, by central differences, all displaced vectors at once."""
    k, h = len(theta), 1e-4 * np.maximum(np.abs(theta), 1e-3)
    h[:2] = np.minimum(h[:2], 0.2 * np.minimum(theta[:2], 1 - theta[:2]))
    h[6:] = np.minimum(h[6:], 0.2 * theta[6:])
    e = np.diag(h)
    pairs = [(i, j) for i in range(k) for j in range(i)]
    moved = [theta, *(theta + e[i] for i in range(k)), *(theta - e[i] for i in range(k))]
    moved += [theta + a * e[i] + b * e[j] for i, j in pairs for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
    with np.errstate(all="ignore"):  # a collapsed fit has no finite Hessian, which `regular` sees
        each = terms(np.array(moved).T, y)
        total, score, hess = each.sum(1), (each[1 : k + 1] - each[k + 1 : 2 * k + 1]).T / (2 * h), np.empty((k, k))
        for i in range(k):
            hess[i, i] = (total[1 + i] - 2 * total[0] + total[1 + k + i]) / h[i] ** 2
        for q, (i, j) in enumerate(pairs):
            four = total[2 * k + 1 + 4 * q : 2 * k + 5 + 4 * q]
            hess[i, j] = hess[j, i] = (four[0] - four[1] - four[2] + four[3]) / (4 * h[i] * h[j])
    return score, hess


def inside(theta: np.ndarray) -> bool:
    return bool((theta[:2] > 0).all() and (theta[:2] < 1).all() and (theta[6:] > 0).all())


def sharpened(theta: np.ndarray, y: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Newton steps from where EM ends: its rounds leave out that the first regime's law depends on the chain."""
    if not inside(theta):
        return theta
    now = loglik(theta[:, None], y)[0]
    for _ in range(rounds):
        score, hess = derivatives(theta, y)
        slope = score.sum(0)
        if not np.isfinite(hess).all() or (np.linalg.eigvalsh(hess) >= 0).any():
            break
        try:
            step = -np.linalg.solve(hess, slope)
        except np.linalg.LinAlgError:  # eigenvalues below zero by rounding alone
            break
        tried = [theta + step * 0.5**i for i in range(6)]
        tried = np.array([x for x in tried if inside(x)]).T
        if not tried.size:
            break
        ll = loglik(tried, y)
        if not ll.max() > now:
            break
        gain, now, theta = ll.max() - now, ll.max(), tried[:, ll.argmax()]
        if gain < 1e-9:
            break
    return theta


def regular(theta: np.ndarray, y: np.ndarray) -> bool:
    """Whether the inverse of the negative Hessian is a covariance: finite, its diagonal positive."""
    if not inside(theta):
        return False
    try:
        c = np.linalg.inv(-derivatives(theta, y)[1])
    except np.linalg.LinAlgError:
        return False
    return bool(np.isfinite(c).all() and (np.diag(c) > 0).all())


def covariances(theta: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Covariance of the estimates by the Hessian, the scores' outer product, and the sandwich of both."""
    score, hess = derivatives(theta, y)
    bread, meat = np.linalg.pinv(-hess), score.T @ score
    return {"hessian": bread, "opg": np.linalg.pinv(meat), "sandwich": bread @ meat @ bread}


def halving(stay: np.ndarray, phi: np.ndarray, level: float = 0.5, most: int = 10_000, stride: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains with stays and slopes (2, n): whole and interpolated hours until a shock in each regime has decayed to ``level``, and what is left after ``most`` hours where it has not.

    All (2, n); hours are infinite where the level is not reached, and left is NaN where it is. The
    kernel's powers up to ``stride`` give that many hours at once; a path need not fall steadily, so
    every hour is looked at.
    """
    kernel = transitions(np.asarray(stay, float)) * np.asarray(phi, float)[None]
    n = kernel.shape[2]
    hours, exact, left = np.full((2, n), np.inf), np.full((2, n), np.inf), np.full((2, n), np.nan)
    with np.errstate(all="ignore"):
        powers = [kernel]
        for _ in range(min(stride, most) - 1):
            powers.append(np.einsum("ijn,jkn->ikn", powers[-1], kernel))
        sums = np.stack([p.sum(1) for p in powers])  # (hours, from, n): what is left of a unit in each regime
        for start in (0, 1):
            weight, before, live = np.eye(2)[start][:, None].repeat(n, 1), np.ones(n), np.arange(n)
            for passed in range(0, most, len(powers)):
                path = np.einsum("in,hin->hn", weight, sums[: most - passed, :, live])
                under = path <= level
                there = under.any(0)
                at = under.argmax(0)
                upto = np.concatenate([before[None], path])
                hi, lo = upto[at, np.arange(len(live))], upto[at + 1, np.arange(len(live))]
                part = np.where(lo > 0, np.log(hi / level) / np.log(hi / lo), (hi - level) / (hi - lo))
                done = live[there]
                hours[start, done], exact[start, done] = passed + at[there] + 1, passed + at[there] + part[there]
                weight = np.einsum("in,ijn->jn", weight, powers[-1][..., live])[:, ~there]
                live, before = live[~there], path[-1, ~there]
                if not len(live):
                    break
            left[start, live] = before
    return hours, exact, left


def half_life_slopes(four: np.ndarray, step: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Switching half-lives of both regimes and their ratio at (p00, p11, phi0, phi1), and their derivatives (3, 4)."""
    h = step * np.maximum(np.abs(four), 1e-3)
    moved = np.stack([four, *(four + d for d in np.diag(h)), *(four - d for d in np.diag(h))], 1)
    _, exact, _ = halving(moved[:2], moved[2:])
    exact = np.where(np.isfinite(exact), exact, np.nan)
    value = np.stack([exact[0], exact[1], exact[0] / exact[1]])
    return value[:, 0], (value[:, 1:5] - value[:, 5:9]) / (2 * h)


def garch_variance(e: np.ndarray, omega: float, alpha: float, beta: float, first: float) -> np.ndarray:
    """h[t] = omega + alpha e[t-1]^2 + beta h[t-1] from h[0] = ``first``."""
    inputs = np.concatenate([[first], omega + alpha * e[:-1] ** 2])
    return chain.recurrence(inputs, beta)


def logistic(x):
    return 1 / (1 + np.exp(np.minimum(-x, 700)))


def garch_parameters(free, nu_free: bool) -> tuple:
    """mu, omega, alpha, beta, nu (None for normal errors) at unconstrained parameters: mu, ln omega, logits of alpha + beta and alpha's share [, ln (nu - 2)].

    The likelihood is flat far out (thin tails have no best nu), so a search may end anywhere there; the logs are held within bounds.
    """
    both, share = logistic(free[2]), logistic(free[3])
    return free[0], math.exp(min(free[1], 50)), both * share, both * (1 - share), 2 + math.exp(min(max(free[4], -20), 10)) if nu_free else None


def garch_loss(free, r: np.ndarray, nu_free: bool) -> float:
    """Negative log-likelihood at unconstrained parameters."""
    mu, omega, alpha, beta, nu = garch_parameters(free, nu_free)
    e = r - mu
    h = np.maximum(garch_variance(e, omega, alpha, beta, e.var()), 1e-300)
    if not nu_free:
        return 0.5 * float((np.log(2 * np.pi * h) + e * e / h).sum())
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    return -float((const - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(e * e / (h * (nu - 2)))).sum())


def nelder_mead(f, x0, step=0.3, rounds=2000, tol=1e-9):
    """Simplex minimisation: the best point and its value."""
    n = len(x0)
    s = np.array([x0, *(x0 + step * np.eye(n)[i] for i in range(n))])
    v = np.array([f(x) for x in s])
    for _ in range(rounds):
        o = np.argsort(v, kind="stable")
        s, v = s[o], v[o]
        if v[-1] - v[0] < tol:
            break
        mid = s[:-1].mean(0)
        tried = mid + (mid - s[-1])
        fv = f(tried)
        if fv < v[0]:
            far = mid + 2 * (mid - s[-1])
            ff = f(far)
            s[-1], v[-1] = (far, ff) if ff < fv else (tried, fv)
        elif fv < v[-2]:
            s[-1], v[-1] = tried, fv
        else:
            near = mid + 0.5 * ((tried if fv < v[-1] else s[-1]) - mid)
            fn = f(near)
            if fn < min(fv, v[-1]):
                s[-1], v[-1] = near, fn
            else:
                s[1:] = s[0] + 0.5 * (s[1:] - s[0])
                v[1:] = [f(x) for x in s[1:]]
    i = int(np.argmin(v))
    return s[i], v[i]


def simulate_garch(mu, omega, alpha, beta, t, rng, nu=None):
    e = rng.standard_normal(t) if nu is None else rng.standard_t(nu, t) * math.sqrt((nu - 2) / nu)
    h, out = omega / max(1 - alpha - beta, 1e-6), np.empty(t)
    for i in range(t):
        out[i] = math.sqrt(h) * e[i]
        h = omega + alpha * out[i] ** 2 + beta * h
    return mu + out


# Spark -----------------------------------------------------------------------------------------


def _theta(row) -> np.ndarray:
    return np.array([row[n] for n in NAMES], float)


def fit_switching(series: DataFrame, keys: list[str], n_starts: int = 40, rounds: int = 5000, tol: float = 1e-8, seed: int = 5, chunk: int = 10) -> DataFrame:
    """Every start of every key's series (keys, n, x): one row each, with whether its Hessian gives a covariance and the series' variance."""

    def of(row):
        y, own = np.asarray(row["x"], float), numbers(row["chunk"], n_starts, chunk)
        theta, ll, n = fit_members(drawn(y, own, seed), y, rounds, tol)
        for i, s in enumerate(own):
            yield {**{c: row[c] for c in keys}, "start": s, "ll": float(ll[i]), **dict(zip(NAMES, map(float, theta[:, i]))), "regular": regular(theta[:, i], y), "spread": float(y.var()), "rounds": int(n[i]), "n": len(y)}

    return each_row(chunks(series.select(*keys, "x"), keys, n_starts, chunk), f"{key_schema(series, keys)}{FIT}", of)


def admissible(fits: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Adds ``excluded``: why a fit is not to be used, or null. A variance under ``floor`` of the series' has collapsed onto a few hours, where the likelihood has no bound."""
    low = F.least("var0", "var1") < floor * F.col("spread")
    return fits.withColumn("excluded", F.when(F.isnan("ll") | F.col("ll").isNull() | (F.abs("ll") == float("inf")), "not finite").when(low, "variance floor").when(~F.col("regular"), "singular Hessian"))


def best_switching(fits: DataFrame, keys: list[str]) -> DataFrame:
    """The admissible fit with the largest log-likelihood, the first of equals."""
    names = [c for c in fits.columns if c not in keys]
    return admissible(fits).where("excluded is null").groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(-F.round("ll", 4), F.col("start"))).alias("m")).select(*keys, "m.*")


def optima_histogram(fits: DataFrame, keys: list[str]) -> DataFrame:
    """How many starts reached each log-likelihood, to two digits, how many of those may be used, and which optimum is the best of these and the most frequent."""
    g = admissible(fits).groupBy(*keys, F.round("ll", 2).alias("ll")).agg(F.count("*").alias("starts"), F.count_if(F.col("excluded").isNull()).alias("usable"))
    w = Window.partitionBy(*keys)
    best = F.max(F.when(F.col("usable") > 0, F.col("ll"))).over(w)
    return g.withColumns({"is_best": F.coalesce(F.col("ll") == best, F.lit(False)), "is_mode": F.col("starts") == F.max("starts").over(w)})


def seed_blocks(series: DataFrame, keys: list[str], blocks: int = 6, n_starts: int = 40, **how) -> DataFrame:
    """(keys, block, ll, reached): the best fit of each of several disjoint blocks of starts, and how many of its starts reached it."""
    fits = admissible(fit_switching(series, keys, blocks * n_starts, **how)).where("excluded is null").withColumn("block", F.floor(F.col("start") / n_starts).cast("int"))
    top = F.max("ll").over(Window.partitionBy(*keys, "block"))
    return fits.withColumn("_top", top).groupBy(*keys, "block").agg(F.max("ll").alias("ll"), F.count_if(F.col("_top") - F.col("ll") < 0.01).alias("reached"))


def inference(series: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, covariance, theta, cov): the estimates in the order of NAMES and their covariances, a row per kind."""

    def of(row):
        for name, c in covariances(_theta(row), np.asarray(row["x"], float)).items():
            yield {**{k: row[k] for k in keys}, "covariance": name, "theta": _theta(row).tolist(), "cov": c.tolist()}

    return each_row(spread(models.drop("x").join(series.select(*keys, "x"), keys), *keys), f"{key_schema(series, keys)}covariance string, theta array<double>, cov array<array<double>>", of)


def _estimate(name: str) -> Column:
    return F.get("theta", F.lit(NAMES.index(name)))


def _cov(a: str, b: str) -> Column:
    return F.get(F.get("cov", F.lit(NAMES.index(a))), F.lit(NAMES.index(b)))


def ratio_report(inferred: DataFrame) -> DataFrame:
    """Half-lives, stays and the chain's persistence with standard errors, and the sets of the half-lives' ratio, by column algebra."""
    from tidemark.functions import ratios as R

    phi = [_estimate("phi0"), _estimate("phi1")]
    var = [_cov("phi0", "phi0"), _cov("phi1", "phi1")]
    both = _cov("phi0", "phi1")
    root = lambda v: F.when(v >= 0, F.sqrt(v))
    out = inferred.withColumns({f"phi{k}": phi[k] for k in (0, 1)} | {f"half_life{k}": R.half_life(phi[k]) for k in (0, 1)} | {f"phi_se{k}": root(var[k]) for k in (0, 1)})
    out = out.withColumns({f"t_unit{k}": (F.col(f"phi{k}") - 1) / F.col(f"phi_se{k}") for k in (0, 1)})
    end = lambda k, s: F.col(f"phi{k}") + s * Z95 * F.col(f"phi_se{k}")
    out = out.withColumns({f"half_life_ci{k}": F.struct(F.when(end(k, -1) <= 0, F.lit(0.0)).otherwise(R.half_life(end(k, -1))).alias("lo"), F.when(end(k, 1) < 1, R.half_life(end(k, 1))).alias("hi")) for k in (0, 1)})
    out = out.withColumns({f"stay{k}": _estimate(f"p{k}{k}") for k in (0, 1)} | {f"stay_se{k}": root(_cov(f"p{k}{k}", f"p{k}{k}")) for k in (0, 1)})
    out = out.withColumns({f"duration{k}": R.expected_duration(F.col(f"stay{k}")) for k in (0, 1)} | {f"duration_se{k}": F.col(f"stay_se{k}") / (1 - F.col(f"stay{k}")) ** 2 for k in (0, 1)})
    persistence = F.col("stay0") + F.col("stay1") - 1
    out = out.withColumns({"share0": R.stationary2(F.col("stay0"), F.col("stay1")), "persistence": persistence, "persistence_se": root(_cov("p00", "p00") + _cov("p11", "p11") + 2 * _cov("p00", "p11"))})
    out = out.withColumn("wald", R.wald(*phi, *var, both)).withColumn("sets", R.ratio_sets(*phi, *var, both))
    side = R.switching_side(F.col("wald.side"), F.col("persistence"), F.col("persistence_se"), *phi)
    return out.withColumn("switching_side", side).drop("theta", "cov")


FOUR = [NAMES.index(n) for n in ("p00", "p11", "phi0", "phi1")]


def switching_delta(inferred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, covariance, half_life0, half_life1, se0, se1, ratio, ratio_se, lo, hi, log_lo, log_hi): half-lives under switching with errors by their derivatives."""
    names = "half_life0 double, half_life1 double, se0 double, se1 double, ratio double, ratio_se double, lo double, hi double, log_lo double, log_hi double"

    def of(row):
        theta, cov = np.asarray(row["theta"], float), np.array([list(map(float, r)) for r in row["cov"]])
        value, slope = half_life_slopes(theta[FOUR])
        var = np.einsum("ij,jk,ik->i", slope, cov[np.ix_(FOUR, FOUR)], slope)
        se = np.sqrt(np.where(var >= 0, var, np.nan))
        r, s = value[2], se[2]
        factor = np.exp(Z95 * s / r) if r > 0 else np.nan
        yield {**{k: row[k] for k in keys}, "covariance": row["covariance"], "half_life0": value[0], "half_life1": value[1], "se0": se[0], "se1": se[1], "ratio": r, "ratio_se": s, "lo": r - Z95 * s, "hi": r + Z95 * s, "log_lo": r / factor, "log_hi": r * factor}

    return each_row(spread(inferred, *keys, "covariance"), f"{key_schema(inferred, keys)}covariance string, {names}", of)


def simulated_ratio(inferred: DataFrame, keys: list[str], draws: int = 50_000, chunk: int = 5_000, seed: int = 9, most: int = 10_000) -> DataFrame:
    """(keys, covariance, draws, lo, hi, lo_hours, hi_hours, infinite, undefined): 95% of the ratio of switching half-lives over draws of the estimates.

    Draws are normal with the estimates' covariance, stays on the logit scale, so every draw is a
    chain. A path that does not halve in ``most`` hours has no bound; if neither does, the higher
    end decides, and a tie is left out. Quantiles are of the draws themselves, of the interpolated
    and of the whole hours.
    """

    def of(row):
        theta, cov = np.asarray(row["theta"], float)[FOUR], np.array([list(map(float, r)) for r in row["cov"]])[np.ix_(FOUR, FOUR)]
        own = numbers(row["chunk"], draws, chunk)
        p = np.clip(theta[:2], 1e-12, 1 - 1e-12)
        scale = np.array([*(1 / (p * (1 - p))), 1.0, 1.0])
        value, vectors = np.linalg.eigh(scale[:, None] * (cov + cov.T) / 2 * scale)
        root = vectors * np.sqrt(np.clip(value, 0, None))
        centre = np.array([*np.log(p / (1 - p)), *theta[2:]])
        z = np.random.default_rng([seed, row["chunk"]]).normal(size=(len(own), 4))
        sample = (centre + z @ root.T).T
        hours, exact, left = halving(logistic(sample[:2]), sample[2:], most=most)
        neither = np.isinf(exact).all(0)
        with np.errstate(all="ignore"):
            ratios = [np.where(neither, np.where(left[0] > left[1], np.inf, np.where(left[0] < left[1], 0.0, np.nan)), h[0] / h[1]) for h in (exact, hours)]
        for a, b, inf in zip(*ratios, np.isinf(exact).any(0), strict=True):
            yield {**{k: row[k] for k in keys}, "covariance": row["covariance"], "ratio": a, "hours": b, "inf": bool(inf)}

    drawn_ = each_row(chunks(inferred, [*keys, "covariance"], draws, chunk), f"{key_schema(inferred, keys)}covariance string, ratio double, hours double, inf boolean", of)
    at = lambda q, c: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})")
    known = drawn_.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("ratio", "hours")})
    return known.groupBy(*keys, "covariance").agg(F.count("*").alias("draws"), at(0.025, "ratio").alias("lo"), at(0.975, "ratio").alias("hi"), at(0.025, "hours").alias("lo_hours"), at(0.975, "hours").alias("hi_hours"), F.avg(F.col("inf").cast("double")).alias("infinite"), F.avg(F.col("ratio").isNull().cast("double")).alias("undefined"))


def influence(series: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, y, y_before, share): each hour's share of the sandwich variance of the half-lives' ratio."""

    def of(row):
        y, theta = np.asarray(row["x"], float), _theta(row)
        score, hess = derivatives(theta, y)
        c, s = theta[4], theta[5]
        lc, ls = np.log(abs(c)), np.log(abs(s))
        slope = np.zeros(8)
        slope[4], slope[5] = -ls / (c * lc**2), 1 / (s * lc)
        part = (score @ (np.linalg.pinv(hess) @ slope)) ** 2
        for t, share in enumerate(part / part.sum(), 1):
            yield {**{k: row[k] for k in keys}, "t": t, "y": y[t], "y_before": y[t - 1], "share": share}

    return each_row(spread(models.join(series.select(*keys, "x"), keys), *keys), f"{key_schema(series, keys)}t int, y double, y_before double, share double", of)


def residuals(series: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, x, mean, var, z, filtered): standardised one-step residuals from the third time on, over the pair of regimes, and the calm regime's causal probability."""

    def of(row):
        y, theta = np.asarray(row["x"], float), _theta(row)[:, None]
        steps, _ = steps_of(theta, y)
        alpha = chain.forward(law(theta), steps)[0][:, 0]  # (2, T)
        q = alpha[:, None, 1:-1] * transitions(theta)  # of the pair, before its hour
        mu, phi, var = theta[2:4], theta[4:6], theta[6:8]
        m = mu[None] + phi[None] * (y[1:-1] - mu[:, None])
        mean = (q * m).sum((0, 1))
        v = (q * (m**2 + var[None])).sum((0, 1)) - mean**2
        for t in range(len(mean)):
            yield {**{k: row[k] for k in keys}, "t": t + 2, "x": y[t + 2], "mean": mean[t], "var": v[t], "z": (y[t + 2] - mean[t]) / math.sqrt(max(v[t], 1e-300)), "filtered": alpha[0, t + 2]}

    return each_row(spread(models.join(series.select(*keys, "x"), keys), *keys), f"{key_schema(series, keys)}t int, x double, mean double, var double, z double, filtered double", of)


def decay(models: DataFrame, keys: list[str], hours: int = 48) -> DataFrame:
    """(keys, start_state, hour, left, closed): what is left of a shock while regimes switch, by folding the 2 x 2 kernel over the hours, and by its eigenvalues."""
    m = lambda i, j: F.col("p00" if i == j == 0 else "p11" if i == j == 1 else "_q0" if i == 0 else "_q1") * F.col(f"phi{j}")
    r = models.withColumns({"_q0": 1 - F.col("p00"), "_q1": 1 - F.col("p11")})
    step = lambda acc, _: F.struct((acc["x"] * F.col("_m00") + acc["y"] * F.col("_m10")).alias("x"), (acc["x"] * F.col("_m01") + acc["y"] * F.col("_m11")).alias("y"))
    r = r.withColumns({f"_m{i}{j}": m(i, j) for i in (0, 1) for j in (0, 1)}).select(*keys, *(f"_m{i}{j}" for i in (0, 1) for j in (0, 1)), F.explode(F.array(F.lit(0), F.lit(1))).alias("start_state"))
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(hours))).alias("hour"))
    first = F.struct((F.col("start_state") == 0).cast("double").alias("x"), (F.col("start_state") == 1).cast("double").alias("y"))
    left = F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(hours)), F.lit(1), F.col("hour")), first, step, lambda a: a["x"] + a["y"])
    return r.select(*keys, "start_state", "hour", left.alias("left"), _closed(F.col("hour")).alias("closed"))


def _closed(h: Column) -> Column:
    """The same through the eigenvalues of the kernel: two real ones, one double one, or a complex pair."""
    half = (F.col("_m00") + F.col("_m11")) / 2
    det = F.col("_m00") * F.col("_m11") - F.col("_m01") * F.col("_m10")
    first = F.when(F.col("start_state") == 0, F.col("_m00") + F.col("_m01")).otherwise(F.col("_m10") + F.col("_m11"))  # left after one hour
    under = half * half - det
    root = F.sqrt(F.abs(under))
    hi, lo = half + root, half - root
    real = ((first - lo) * F.pow(hi, h) + (hi - first) * F.pow(lo, h)) / (hi - lo)
    double = F.pow(half, h) + F.when(h > 0, h * F.pow(half, h - 1) * (first - half)).otherwise(0.0)
    turn = F.atan2(root, half) * h
    pair = F.pow(F.sqrt(F.abs(det)), h) * (F.cos(turn) + (first - half) / root * F.sin(turn))
    return F.when(F.abs(under) <= 1e-14 * F.greatest(half * half, F.lit(1e-300)), double).when(under > 0, real).otherwise(pair)


def switching_half_life(p00, p11, phi0, phi1, start: int, level: float = 0.5, most: int = 100_000) -> float:
    """Hours, log-linearly interpolated, until a shock in regime ``start`` has decayed to ``level`` while regimes switch."""
    return float(halving(np.array([[p00], [p11]]), np.array([[phi0], [phi1]]), level, most)[1][start, 0])


def fit_garch(series: DataFrame, keys: list[str], dists=("normal", "t"), scale: float = 1e4) -> DataFrame:
    """GARCH(1,1) per key and distribution, from four starts: (keys, dist, start, ll, mu, omega, alpha, beta, nu, n)."""
    plan = series.select(*keys, "x", F.explode(F.array(*map(F.lit, dists))).alias("dist")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("start"))
    plan = spread(plan, *keys, "dist", "start")

    def of(row):
        r = np.asarray(row["x"], float) * scale
        free = [r.mean(), math.log(max(r.var(), 1e-300) * 0.05), (2.0, 3.0, 1.0, 4.0)[row["start"]], (-2.0, -1.0, 0.0, -3.0)[row["start"]]]
        student = row["dist"] == "t"
        x, loss = nelder_mead(lambda p: garch_loss(p, r, student), np.array(free + [math.log(4.0)] * student))
        mu, omega, alpha, beta, nu = garch_parameters(x, student)  # those at which the loss was taken
        yield {**{k: row[k] for k in keys}, "dist": row["dist"], "start": row["start"], "ll": -loss + len(r) * math.log(scale), "mu": mu / scale, "omega": omega / scale**2, "alpha": alpha, "beta": beta, "nu": nu, "n": len(r)}

    fits = each_row(plan, f"{key_schema(series, keys)}dist string, start int, ll double, mu double, omega double, alpha double, beta double, nu double, n long", of)
    names = [c for c in fits.columns if c not in [*keys, "dist"]]
    return fits.groupBy(*keys, "dist").agg(F.min_by(F.struct(*names), F.struct(-F.round("ll", 6), F.col("start"))).alias("m")).select(*keys, "dist", "m.*")


def chains_on_garch(garch: DataFrame, keys: list[str], ks=(1, 2, 3), paths: int = 30, n_starts: int = 4, rounds: int = 1000, tol: float = 1e-3, seed: int = 31, chunk: int = 6) -> DataFrame:
    """(keys, dist, k, paths, preferred): how many Gaussian chains of each size BIC prefers on paths simulated from fitted GARCH models, which have no states at all."""
    from tidemark.operators import markov as M

    def of(row):
        own, nu = numbers(row["chunk"], paths, chunk), None if row["nu"] is None or np.isnan(row["nu"]) else row["nu"]
        x = np.stack([simulate_garch(row["mu"], row["omega"], row["alpha"], row["beta"], int(row["n"]), np.random.default_rng([seed, p]), nu) for p in own])
        bic = []
        for k in ks:
            if k == 1:
                ll = -x.shape[1] / 2 * (np.log(2 * math.pi * x.var(1)) + 1)
            else:  # all paths and starts at once
                m = tuple(np.concatenate(c, -1) for c in zip(*(M.drawn(v, k, range(n_starts), seed) for v in x), strict=True))
                ll = M.em(np.repeat(x, n_starts, 0), m, rounds, tol)[1].reshape(len(x), n_starts).max(1)
            bic.append((k * k + 2 * k - 1) * math.log(x.shape[1]) - 2 * ll)
        for i, p in enumerate(own):
            for k, b in zip(ks, bic, strict=True):
                yield {**{c: row[c] for c in keys}, "dist": row["dist"], "k": k, "path": p, "preferred": bool(b[i] == min(v[i] for v in bic))}

    found = each_row(chunks(garch, [*keys, "dist"], paths, chunk), f"{key_schema(garch, keys)}dist string, k int, path int, preferred boolean", of)
    return found.groupBy(*keys, "dist", "k").agg(F.count("*").alias("paths"), F.count_if("preferred").alias("preferred"))
