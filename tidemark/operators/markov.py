"""Gaussian hidden Markov models: a task per chunk of starts, replicates or values, a row per fit.

A model is a row (k, pi, a, mu, sigma, ll) with states in ascending order of sigma. The kernels
work on a batch of members at once, states first (see ``chain``), times in blocks; Spark deals
members to tasks, keeps the best and sums up. A series (keys, n, x) goes to a task as one array.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import chain

MODEL = "k int, pi array<double>, a array<array<double>>, mu array<double>, sigma array<double>, ll double"
LOWEST_VAR = 1e-12
Batch = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # pi (k, r), a (k, k, r), mu (k, r), sigma (k, r)


# kernels -------------------------------------------------------------------------------------


def densities(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, members, T) densities divided by the largest of each time, and the logs of those divisors; ``x`` is (T,) or (members, T)."""
    z = (np.atleast_2d(x)[None] - mu[..., None]) / sigma[..., None]
    log = -0.5 * z * z - np.log(sigma)[..., None] - 0.5 * np.log(2 * np.pi)
    top = log.max(0)
    return np.exp(log - top), top


def steps_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., None] * b[None, :, :, 1:]


def filtered(x: np.ndarray, m: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Causal state probabilities (k, r, T), log-likelihoods, and the densities."""
    b, top = densities(x, m[2], m[3])
    alpha, log = chain.forward(m[0] * b[..., 0], steps_of(m[1], b))
    return alpha, log[:, -1] + top.sum(1), b


def expectation(x: np.ndarray, m: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-sided probabilities (k, r, T), expected numbers of each transition (k, k, r), log-likelihoods."""
    b, top = densities(x, m[2], m[3])
    steps = steps_of(m[1], b)
    alpha, log, beta = chain.both(m[0] * b[..., 0], steps)
    gamma, pairs = chain.smoothed(alpha, beta, steps)
    return gamma, pairs.sum(3), log[:, -1] + top.sum(1)


def loglik(x: np.ndarray, m: Batch) -> np.ndarray:
    return filtered(x, m)[1]


def scores(x: np.ndarray, m: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the log-likelihood in each transition (k, k, r), those at 0 included, and the expected visits of each state with a next time (k, r)."""
    alpha, _, b = filtered(x, m)
    beta = chain.backward(steps_of(m[1], b))
    ahead = b[..., 1:] * beta[..., 1:]  # of the state that follows
    norm = (alpha[..., :-1] * (m[1][..., None] * ahead[None]).sum(1)).sum(0)
    slope = np.einsum("irt,jrt->ijr", alpha[..., :-1] / np.maximum(norm, chain.LEAST), ahead)
    gamma = alpha * beta
    return slope, (gamma / gamma.sum(0))[..., :-1].sum(2)


def held(a: np.ndarray, cell: tuple[int, int], value) -> np.ndarray:
    """Transitions with one cell at ``value`` (one or one per member), the rest of its row sharing what is left."""
    i, j = cell
    out, rest = a.copy(), a[i].copy()
    rest[j] = 0
    out[i] = rest / np.maximum(rest.sum(0), chain.LEAST) * (1 - value)
    out[i, j] = value
    return out


def maximisation(x: np.ndarray, gamma: np.ndarray, pairs: np.ndarray, fixed: tuple[tuple[int, int], np.ndarray] | None = None) -> Batch:
    """New parameters; ``fixed`` holds one transition (cell, value per member)."""
    x = np.atleast_2d(x)
    a = pairs / np.maximum(pairs.sum(1, keepdims=True), chain.LEAST)
    if fixed:
        a = held(a, *fixed)
    weight = np.maximum(gamma.sum(2), chain.LEAST)
    mu = (gamma * x).sum(2) / weight
    var = (gamma * (x - mu[..., None]) ** 2).sum(2) / weight
    return gamma[..., 0] / gamma[..., 0].sum(0), a, mu, np.sqrt(np.maximum(var, LOWEST_VAR))


def largest_move(old: Batch, new: Batch) -> np.ndarray:
    """Per member the largest change of a parameter: means and scales in units of the old scales, probabilities as they are."""
    return np.max([np.abs(new[0] - old[0]).max(0), np.abs(new[1] - old[1]).max((0, 1)), (np.abs(new[2] - old[2]) / old[3]).max(0), (np.abs(new[3] - old[3]) / old[3]).max(0)], axis=0)


def take(m: Batch, which) -> Batch:
    return tuple(p[..., which] for p in m)


def _flat(m: Batch) -> np.ndarray:
    """Transitions, means and scales on scales without bounds: (parameters, members)."""
    return np.concatenate([np.log(np.maximum(m[1], chain.LEAST)).reshape(-1, m[1].shape[-1]), m[2], np.log(m[3])])


def _ahead(zero: Batch, one: Batch, two: Batch, fixed) -> Batch:
    """Where the moves of two rounds of EM point to: a squared extrapolation per member, never short of the second round."""
    f0, f1, f2 = map(_flat, (zero, one, two))
    move, bend = f1 - f0, f2 - 2 * f1 + f0
    size = np.minimum(-np.sqrt((move**2).sum(0) / np.maximum((bend**2).sum(0), chain.LEAST)), -1.0)
    size = np.maximum(size, -64.0)
    at = f0 - 2 * size * move + size**2 * bend
    k, r = two[2].shape
    log = np.clip(at[: k * k], f2[: k * k] - 1.5, f2[: k * k] + 1.5).reshape(k, k, r)  # a jump must not end at a transition of 0, which EM never leaves
    a = np.exp(log - log.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    if fixed:
        a = held(a, *fixed)
    sigma = np.sqrt(np.maximum(np.exp(2 * np.clip(at[k * k + k :], -300, 300)), LOWEST_VAR))
    return two[0], a, at[k * k : k * k + k], sigma


def em(x: np.ndarray, m: Batch, rounds: int, tol: float, fixed=None, least: int = 6, step_tol: float | None = None, looks: tuple[int, ...] = (), jump: bool = True):
    """EM for a batch of members: (parameters, log-likelihoods, rounds, those stopped by tolerance, {round: log-likelihoods} at ``looks``).

    A member leaves when a round gains less than ``tol`` after ``least`` rounds and, with ``step_tol``,
    moves no parameter by more than that. After every second round each member tries to jump ahead,
    and falls back to where it was if the likelihood there is lower; with ``looks``, or without
    ``jump``, rounds are plain.
    """
    x = np.atleast_2d(np.asarray(x, float))
    r = m[0].shape[1]
    done, live = tuple(p.copy() for p in m), np.arange(r)
    ll, n, stopped, seen = np.full(r, -np.inf), np.zeros(r, int), np.zeros(r, bool), {}
    now, safe, floor, zero = done, None, None, None  # of the live members: parameters, where to fall back to, the likelihood to beat, parameters a round ago
    for i in range(1, rounds + 1):
        own, held_at = x if len(x) == 1 else x[live], (fixed[0], np.broadcast_to(fixed[1], r)[live]) if fixed else None
        gamma, pairs, new = expectation(own, now)
        if safe is not None:  # after a jump
            worse = np.flatnonzero(~(new >= floor))
            if len(worse):
                now = tuple(p.copy() for p in now)
                for p, q in zip(now, safe, strict=True):
                    p[..., worse] = q[..., worse]
                g, q, l = expectation(own if len(own) == 1 else own[worse], take(now, worse))
                gamma[:, worse], pairs[..., worse], new[worse] = g, q, l
        gain = new - (ll[live] if floor is None else floor)
        fresh = maximisation(own, gamma, pairs, held_at)
        ll[live], n[live] = new, i
        if i in looks:
            seen[i] = ll.copy()
        # after a jump the gain is over two rounds or more, so only plain rounds may end a member
        rest = np.ones(len(live), bool) if safe is not None else ~((gain < tol) & (i > least))
        if step_tol is not None:
            rest |= largest_move(now, fresh) > step_tol
        for p, q in zip(done, now, strict=True):
            p[..., live] = q
        stopped[live[~rest]] = True
        if not rest.any():
            break
        live, now, fresh, new = live[rest], take(now, rest), take(fresh, rest), new[rest]
        if zero is not None and jump and not looks:
            there = _ahead(take(zero, rest), now, fresh, (held_at[0], held_at[1][rest]) if fixed else None)
            safe, floor, zero, now = fresh, new, None, there
        else:
            safe, floor, zero, now = None, None, now, fresh
    else:
        for p, q in zip(done, now if safe is None else safe, strict=True):
            p[..., live] = q
    return done, loglik(x, done), n, stopped, seen


def by_order(m: Batch, key: int = 3) -> Batch:
    """Members with states renumbered in ascending order of sigma (3) or mu (2)."""
    order = np.argsort(m[key], axis=0, kind="stable")
    move = lambda p: np.take_along_axis(p, order, 0)
    rows = np.take_along_axis(m[1], order[:, None], 0)
    return move(m[0]), np.take_along_axis(rows, order[None], 1), move(m[2]), move(m[3])


def drawn(x: np.ndarray, k: int, numbers, seed: int, kind: str = "random") -> Batch:
    """Starts by number, from a quasi-random sequence of their own each: means at shifted quantiles, sticky or loose rows.

    ``random`` scales lie within a factor of two of the whole's, ``spread`` ones within 25.
    """
    sd, members = x.std() + 1e-12, []
    for number in numbers:
        u = np.random.default_rng([seed, k, int(number), len(kind)])
        at = np.sort((np.arange(k) + u.uniform(0, 1, k)) / k)
        stay = u.uniform(0.3, 0.98, k)
        leave = u.exponential(1.0, (k, k)) * (1 - np.eye(k))
        a = leave / np.maximum(leave.sum(1, keepdims=True), 1e-12) * (1 - stay[:, None]) + np.diag(stay if k > 1 else np.ones(k))
        reach = np.log(2.0 if kind == "random" else 25.0)
        members.append((np.full(k, 1 / k), a, np.quantile(x, at), sd * np.exp(u.uniform(-reach, reach / 2, k))))
    return tuple(np.stack(p, -1) for p in zip(*members, strict=True))


def split(parent: Batch, factors=(0.5, 0.8, 1.25)) -> Batch:
    """Starts with a state more: each state of the one parent becomes two, with scales and means a factor apart."""
    pi, a, mu, sigma = (p[..., 0] for p in parent)
    k, members = len(mu), []
    for s in range(k):
        order = [*range(k), s]
        for f in factors:
            new_a = a[np.ix_(order, order)].copy()
            new_a[:, [s, k]] /= 2  # who came to the state comes to either half
            new_sigma, new_mu = sigma[order].copy(), mu[order].copy()
            new_sigma[s], new_sigma[k] = sigma[s] * f, sigma[s] / f
            new_mu[s], new_mu[k] = mu[s] - (1 - f) * sigma[s] / 4, mu[s] + (1 - f) * sigma[s] / 4
            new_pi = pi[order].copy()
            new_pi[[s, k]] /= 2
            members.append((new_pi, new_a, new_mu, new_sigma))
    return tuple(np.stack(p, -1) for p in zip(*members, strict=True))


def most_likely_path(x: np.ndarray, m: Batch) -> np.ndarray:
    """The jointly most probable states of one member."""
    b, top = densities(x, m[2], m[3])
    log_b = (np.log(np.maximum(b[:, 0], chain.LEAST)) + top[0]).T
    log_a, score = np.log(np.maximum(m[1][..., 0], chain.LEAST)), np.log(np.maximum(m[0][:, 0], chain.LEAST)) + log_b[0]
    back = np.zeros(log_b.shape, np.int8)
    for i in range(1, len(x)):
        step = score[:, None] + log_a
        back[i] = step.argmax(0)
        score = step.max(0) + log_b[i]
    path = np.empty(len(x), np.int64)
    path[-1] = score.argmax()
    for i in range(len(x) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def simulated(a: np.ndarray, mu: np.ndarray, sigma: np.ndarray, t: int, seeds) -> np.ndarray:
    """Paths from the stationary law, one per seed, all stepped together: (paths, t)."""
    draws = [np.random.default_rng(s) for s in seeds]
    u, e = np.stack([g.uniform(size=t) for g in draws]), np.stack([g.normal(size=t) for g in draws])
    upto = np.cumsum(a, axis=1)
    states = np.empty(u.shape, np.int64)
    edges = np.broadcast_to(np.cumsum(stationary(a)), (len(u), len(mu)))
    for i in range(t):
        states[:, i] = np.minimum((u[:, i, None] >= edges).sum(1), len(mu) - 1)
        edges = upto[states[:, i]]
    return mu[states] + sigma[states] * e


def stationary(a: np.ndarray) -> np.ndarray:
    k = len(a)
    p = np.linalg.lstsq(np.vstack([a.T - np.eye(k), np.ones(k)]), np.append(np.zeros(k), 1.0), rcond=None)[0]
    p = np.clip(p, 0, None)
    return p / p.sum()


def from_diagonal(diagonal, law, zero: tuple[int, int]) -> np.ndarray:
    """The 3 x 3 transitions with this diagonal and stationary law and one cell at 0: six linear equations for the six other cells."""
    d, law = np.asarray(diagonal, float), np.asarray(law, float)
    if zero[0] == zero[1] or d.shape != (3,) or law.shape != (3,):
        raise ValueError("three states, and a zero off the diagonal")
    cells = [(i, j) for i in range(3) for j in range(3) if i != j]
    rows, right = [], []
    for s in range(3):
        rows.append([float(i == s) for i, _ in cells])  # what leaves a state
        right.append(1 - d[s])
        rows.append([law[i] * (j == s) for i, j in cells])  # what comes to it
        right.append(law[s] * (1 - d[s]))
    rows.append([float(c == tuple(zero)) for c in cells])
    right.append(0.0)
    out = np.diag(d)
    for (i, j), v in zip(cells, np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0], strict=True):
        out[i, j] = v
    return out


def batch_of(row) -> Batch:
    """Parameters of a model row as a batch of one."""
    return tuple(np.array([[float(v) for v in r] for r in row[c]] if c == "a" else row[c], float)[..., None] for c in ("pi", "a", "mu", "sigma"))


def row_of(m: Batch, i: int, ll) -> dict:
    pi, a, mu, sigma = (p[..., i] for p in m)
    return {"k": len(mu), "pi": pi.tolist(), "a": a.tolist(), "mu": mu.tolist(), "sigma": sigma.tolist(), "ll": float(ll)}


# Spark -----------------------------------------------------------------------------------------


def as_arrays(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, n, x): each key's series as an array in order."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("x"))


def key_schema(rows: DataFrame, keys: list[str]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)


def each_row(rows: DataFrame, schema: str, of) -> DataFrame:
    """``of(row as dict)`` gives the dicts of its result rows."""
    names = [x.split()[0] for x in schema_fields(schema)]

    def run(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.to_dict("records"):
                yield pd.DataFrame(list(of(row)), columns=names)

    return rows.mapInPandas(run, schema)


def schema_fields(schema: str) -> list[str]:
    """The fields of a flat schema string."""
    from pyspark.sql.types import StructType

    return [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(schema)]


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Deal few, small, costly rows to tasks. By number, as adaptive execution puts small partitions of others together."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def chunks(rows: DataFrame, keys: list[str], total: int, size: int) -> DataFrame:
    """A row per chunk of ``size`` of ``total`` numbers (column chunk), spread over tasks."""
    return spread(rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((total - 1) // size)))), *keys, "chunk")


def numbers(chunk: int, total: int, size: int) -> range:
    return range(chunk * size, min(total, (chunk + 1) * size))


def fit(series: DataFrame, keys: list[str], ks=(2, 3), n_starts: int = 8, rounds: int = 500, tol: float = 1e-6, seed: int = 1, chunk: int = 10, kinds=("random",)) -> DataFrame:
    """All starts of all keys and numbers of states: (keys, start, kind, rounds, model columns, n).

    ``kinds``: random and spread starts. Starts go to tasks in chunks; the parameters of a start
    depend on its number alone.
    """
    plan = series.select(*keys, "n", "x", F.explode(F.array(*map(F.lit, ks))).alias("k")).select("*", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))

    def of(row):
        x, own = np.asarray(row["x"], float), numbers(row["chunk"], n_starts, chunk)
        m, ll, n, _, _ = em(x, drawn(x, int(row["k"]), own, seed, row["kind"]), rounds, tol)
        m = by_order(m)
        for i, s in enumerate(own):
            yield {**{c: row[c] for c in keys}, "start": s, "kind": row["kind"], "rounds": int(n[i]), **row_of(m, i, ll[i]), "n": int(row["n"])}

    return each_row(chunks(plan, [*keys, "k", "kind"], n_starts, chunk), f"{key_schema(series, keys)}start int, kind string, rounds int, {MODEL}, n long", of)


def best(fits: DataFrame, keys: list[str]) -> DataFrame:
    """The fit with the largest log-likelihood per key; the first start among equals."""
    names = [c for c in fits.columns if c not in keys]
    return fits.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(-F.round("ll", 6), F.col("kind"), F.col("start"))).alias("m")).select(*keys, "m.*")


def fit_split(series: DataFrame, parents: DataFrame, keys: list[str], factors=(0.5, 0.8, 1.25), rounds: int = 500, tol: float = 1e-6) -> DataFrame:
    """Fits with a state more than ``parents`` (one model per key), started from splits of each of their states; columns of :func:`fit`, kind split."""

    def of(row):
        m, ll, n, _, _ = em(np.asarray(row["x"], float), split(batch_of(row), factors), rounds, tol)
        m = by_order(m)
        for i in range(len(ll)):
            yield {**{c: row[c] for c in keys}, "start": i, "kind": "split", "rounds": int(n[i]), **row_of(m, i, ll[i]), "n": int(row["n"])}

    joined = spread(parents.drop("n").join(series.select(*keys, "n", "x"), keys), *keys, "k")
    return each_row(joined, f"{key_schema(series, keys)}start int, kind string, rounds int, {MODEL}, n long", of)


def fit_wide(series: DataFrame, keys: list[str], k: int, n_random: int, n_spread: int, parents: DataFrame | None = None, rounds: int = 500, tol: float = 1e-6) -> DataFrame:
    """Random and spread starts, and splits of ``parents`` with a state less: one table of fits."""
    out = fit(series, keys, (k,), n_random, rounds, tol)
    if n_spread:
        out = out.unionByName(fit(series, keys, (k,), n_spread, rounds, tol, seed=2, kinds=("spread",)))
    return out if parents is None else out.unionByName(fit_split(series, parents, keys, rounds=rounds, tol=tol))


def reached(fits: DataFrame, keys: list[str], near: float = 0.1) -> DataFrame:
    """(keys, kind, starts, reached, best): per family of starts how many came within ``near`` of the best fit of all."""
    top = F.max("ll").over(Window.partitionBy(*keys))
    return fits.withColumn("_top", top).groupBy(*keys, "kind").agg(F.count("*").alias("starts"), F.count_if(F.col("_top") - F.col("ll") <= near).alias("reached"), F.max("ll").alias("best"))


def optima(fits: DataFrame, keys: list[str], apart: float = 0.1) -> DataFrame:
    """Distinct optima per key: runs of log-likelihoods less than ``apart`` apart, with the number of starts that reached each."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ll"))
    new = F.coalesce((F.lag("ll").over(w) - F.col("ll") > apart).cast("int"), F.lit(0))
    return fits.withColumn("_new", new).withColumn("optimum", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "optimum").agg(F.max("ll").alias("ll"), F.count("*").alias("starts"))


def selection(models: DataFrame, keys: list[str]) -> DataFrame:
    """Information criteria per number of states, and the number that BIC prefers (the smaller of equals)."""
    from tidemark.functions.ratios import free_parameters, information_criteria

    ic = models.withColumn("_ic", information_criteria(F.col("ll"), free_parameters(F.col("k")), F.col("n"))).select(*keys, "k", "n", "ll", "_ic.*")
    w = Window.partitionBy(*keys)
    return ic.withColumns({"delta_bic": F.col("bic") - F.min("bic").over(w), "preferred": F.min_by("k", F.struct("bic", "k")).over(w)})


def polish(series: DataFrame, models: DataFrame, keys: list[str], rounds: int = 5000, tol: float = 1e-9, step_tol: float | None = None) -> DataFrame:
    """EM from the given models to a finer tolerance of likelihood and, if wanted, of parameters; same columns."""

    def of(row):
        m, ll, _, _, _ = em(np.asarray(row["x"], float), batch_of(row), rounds, tol, step_tol=step_tol)
        yield {**row, **row_of(by_order(m), 0, ll[0])}

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in models.schema)
    return each_row(spread(models.join(series.select(*keys, "x"), keys).select(*models.columns, "x"), *keys, "k"), schema, of)


def protocol(series: DataFrame, keys: list[str], ks=(2,), n_starts: int = 8, rounds: int = 100_000, tol: float = 1e-6, polish_tol: float = 1e-9, step_tol: float = 1e-10) -> DataFrame:
    """All starts, the best of each number of states, polished: a model row per key and k."""
    fits = fit(series, keys, ks, n_starts, rounds, tol)
    return polish(series, best(fits, [*keys, "k"]), keys, rounds, polish_tol, step_tol)


def progress(series: DataFrame, keys: list[str], k: int, n_starts: int, looks: tuple[int, ...], tol: float = 1e-10, seed: int = 1, chunk: int = 20) -> DataFrame:
    """(keys, start, round, ll, left): the log-likelihood of every start at given rounds, and what it still gained until its end."""

    def of(row):
        x, own = np.asarray(row["x"], float), numbers(row["chunk"], n_starts, chunk)
        _, ll, _, _, seen = em(x, drawn(x, k, own, seed), max(100_000, *looks), tol, looks=looks)
        for r in looks:
            for i, s in enumerate(own):
                now = seen.get(r, ll)[i]
                yield {**{c: row[c] for c in keys}, "start": s, "round": r, "ll": float(now), "left": float(ll[i] - now)}

    return each_row(chunks(series.select(*keys, "x"), keys, n_starts, chunk), f"{key_schema(series, keys)}start int, round int, ll double, left double", of)


def states(series: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, t, x, filtered, smoothed, state, mean, var): probabilities, the most likely path, and one-step forecasts, by place t."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.to_dict("records"):
                x, m = np.asarray(row["x"], float), batch_of(row)
                alpha, _, _ = filtered(x, m)
                gamma, _, _ = expectation(x, m)
                pi, a, mu, sigma = (p[..., 0] for p in m)
                ahead = np.vstack([pi, alpha[:, 0, :-1].T @ a])
                mean = ahead @ mu
                var = ahead @ (sigma**2 + mu**2) - mean**2
                yield pd.DataFrame({**{c: [row[c]] * len(x) for c in keys}, "k": int(row["k"]), "t": np.arange(len(x)), "x": x, "filtered": list(alpha[:, 0].T), "smoothed": list(gamma[:, 0].T), "state": most_likely_path(x, m), "mean": mean, "var": var})

    schema = f"{key_schema(series, keys)}k int, t long, x double, filtered array<double>, smoothed array<double>, state int, mean double, var double"
    return models.join(series.select(*keys, "x"), keys).mapInPandas(run, schema)


def residuals(state_rows: DataFrame) -> DataFrame:
    """Standardised one-step residuals from the second row on."""
    return state_rows.where("t > 0").withColumn("z", (F.col("x") - F.col("mean")) / F.sqrt("var"))


def durations(model: Column | str = "a") -> Column:
    """Expected stay in each state, 1 / (1 - a_kk)."""
    return F.transform(F.col(model) if isinstance(model, str) else model, lambda row, i: 1 / (1 - F.get(row, i)))


def bootstrap(models: DataFrame, keys: list[str], t: int | None, reps: int = 500, seed: int = 20, rounds: int = 400, tol: float = 1e-5, chunk: int = 25, check: int = 0, n_starts: int = 8) -> DataFrame:
    """(keys, rep, rounds, swapped, checked_ll, model columns): models refitted to simulated paths of ``t`` steps (None: as many as the model's series, its n), one row per replicate.

    ``swapped``: whether the order by sigma is another than that by mu is in the model. The first
    ``check`` replicates are fitted from ``n_starts`` random starts too; ``checked_ll`` is the best of those.
    """
    plan = models.select(*keys, "k", "pi", "a", "mu", "sigma", (F.col("n") if t is None else F.lit(t)).cast("int").alias("t"))

    def of(row):
        m, own = batch_of(row), numbers(row["chunk"], reps, chunk)
        x = simulated(m[1][..., 0], m[2][:, 0], m[3][:, 0], row["t"], [[seed, r] for r in own])
        fitted, ll, n, _, _ = em(x, tuple(np.repeat(p, len(own), -1) for p in m), rounds, tol)
        fitted = by_order(fitted)
        was = np.argsort(m[2][:, 0], kind="stable")
        for i, r in enumerate(own):
            again = float(em(x[i], drawn(x[i], int(row["k"]), range(n_starts), seed), rounds, tol)[1].max()) if r < check else None
            yield {**{c: row[c] for c in keys}, "rep": r, "rounds": int(n[i]), "swapped": bool((np.argsort(fitted[2][:, i], kind="stable") != was).any()), "checked_ll": again, **row_of(fitted, i, ll[i])}

    return each_row(chunks(plan, keys, reps, chunk), f"{key_schema(models, keys)}rep int, rounds int, swapped boolean, checked_ll double, {MODEL}", of)


def _long(models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parameter, v): a row per parameter of each model."""
    cells = F.flatten(F.transform("a", lambda row, i: F.transform(row, lambda v, j: F.struct(F.concat(F.lit("a_"), i.cast("string"), F.lit("_"), j.cast("string")).alias("parameter"), v.alias("v")))))
    one = lambda name: F.transform(name, lambda v, i: F.struct(F.concat(F.lit(f"{name}_"), i.cast("string")).alias("parameter"), v.alias("v")))
    return models.select(*keys, F.inline(F.concat(cells, one("mu"), one("sigma"))))


def by_mu(models: DataFrame) -> DataFrame:
    """Model rows with states renumbered in ascending order of mu."""
    order = F.transform(F.array_sort(F.transform("mu", lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda s: s["i"])
    put = lambda c: F.transform("_order", lambda i: F.get(c, i))
    rows = F.transform("_order", lambda i: F.transform("_order", lambda j: F.get(F.get("a", i), j)))
    return models.withColumn("_order", order).withColumns({"a": rows, "pi": put("pi"), "mu": put("mu"), "sigma": put("sigma")}).drop("_order")


def bootstrap_summary(reps: DataFrame, point: DataFrame, keys: list[str], zero: float = 1e-6) -> DataFrame:
    """(keys, labels, parameter, point, mean, bias, se, lo, hi, at_zero): over the replicates, per parameter, with states in order of sigma and of mu; at_zero is the share of replicates below ``zero``."""
    out = None
    for labels, order in (("sigma", lambda d: d), ("mu", by_mu)):
        g = _long(order(reps), keys).groupBy(*keys, "parameter").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("se"), F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"), F.avg((F.abs("v") < zero).cast("double")).alias("at_zero"))
        p = _long(order(point), keys).withColumnRenamed("v", "point")
        r = p.join(g, [*keys, "parameter"]).select(*keys, F.lit(labels).alias("labels"), "parameter", "point", "mean", (F.col("mean") - F.col("point")).alias("bias"), "se", F.get("_q", F.lit(0)).alias("lo"), F.get("_q", F.lit(1)).alias("hi"), "at_zero")
        out = r if out is None else out.unionByName(r)
    return out


def bootstrap_check(reps: DataFrame, keys: list[str], near: float = 1e-3) -> DataFrame:
    """(keys, replicates, swapped, checked, short, worst): how often labels changed, and how often a refit from the truth fell ``near`` or more short of a search from random starts."""
    short = F.col("checked_ll") - F.col("ll")
    return reps.groupBy(*keys).agg(F.count("*").alias("replicates"), F.count_if("swapped").alias("swapped"), F.count("checked_ll").alias("checked"), F.count_if(short > near).alias("short"), F.max(short).alias("worst"))


def power(models: DataFrame, keys: list[str], cell: tuple[int, int], values, reps: int = 200, seed: int = 21, rounds: int = 400, tol: float = 1e-5, zero: float = 1e-6, chunk: int = 25) -> DataFrame:
    """(keys, value, replicates, at_zero, mean): the share of refits with a transition at zero when its true value is each of ``values``."""
    plan = models.select(*keys, "k", "pi", "a", "mu", "sigma", "n", F.explode(F.array(*map(F.lit, map(float, values)))).alias("value"))

    def of(row):
        pi, a, mu, sigma = batch_of(row)
        a, own = held(a, cell, row["value"]), numbers(row["chunk"], reps, chunk)
        x = simulated(a[..., 0], mu[:, 0], sigma[:, 0], int(row["n"]), [[seed, r, int(1e6 * row["value"])] for r in own])
        fitted, _, _, _, _ = em(x, tuple(np.repeat(p, len(own), -1) for p in (pi, a, mu, sigma)), rounds, tol)
        for i, r in enumerate(own):
            yield {**{c: row[c] for c in keys}, "value": row["value"], "rep": r, "at": float(by_order(fitted)[1][cell[0], cell[1], i])}

    found = each_row(chunks(plan, [*keys, "value"], reps, chunk), f"{key_schema(models, keys)}value double, rep int, at double", of)
    return found.groupBy(*keys, "value").agg(F.count("*").alias("replicates"), F.avg((F.col("at") < zero).cast("double")).alias("at_zero"), F.avg("at").alias("mean"))


# a transition near zero ----------------------------------------------------------------------


def boundary_score(series: DataFrame, models: DataFrame, keys: list[str], cell: tuple[int, int], rounds: int = 5000, tol: float = 1e-10) -> DataFrame:
    """(keys, ratio, at_boundary, ll_zero): with a transition held at 0 and the rest refitted, the slope of the likelihood in it per visit of its state.

    Up to 1 the likelihood does not rise when the transition leaves 0, so its estimate is 0.
    """

    def of(row):
        x, m = np.asarray(row["x"], float), batch_of(row)
        ratio, at_zero, ll, _ = _decision(x, m, cell, rounds, tol)
        yield {**{c: row[c] for c in keys}, "ratio": ratio, "at_boundary": at_zero, "ll_zero": ll}

    return each_row(spread(models.join(series.select(*keys, "x"), keys), *keys), f"{key_schema(series, keys)}ratio double, at_boundary boolean, ll_zero double", of)


def _constrained(x, m: Batch, cell, values, rounds: int, tol: float):
    """EM with the cell held at each of ``values``, all at once, from one model."""
    values = np.atleast_1d(np.asarray(values, float))
    start = tuple(np.repeat(p, len(values), -1) for p in m)
    start = start[0], held(start[1], cell, values), *start[2:]
    return em(x, start, rounds, tol, fixed=(cell, values))


def _decision(x, m: Batch, cell, rounds: int, tol: float):
    at, ll, _, _, _ = _constrained(x, m, cell, 0.0, rounds, tol)
    slope, visits = scores(x, at)
    ratio = float(slope[cell[0], cell[1], 0] / visits[cell[0], 0])
    return ratio, ratio <= 1, float(ll[0]), at


def cell_estimate(series: DataFrame, models: DataFrame, keys: list[str], cell: tuple[int, int], leave: float = 1e-3, rounds: int = 5000, tol: float = 1e-10) -> DataFrame:
    """(keys, at_boundary, estimate, ll_max, ll_zero): a transition's estimate; where it is not 0, EM leaves the maximum at 0 from ``leave``."""

    def of(row):
        x = np.asarray(row["x"], float)
        _, at_zero, ll_zero, at = _decision(x, batch_of(row), cell, rounds, tol)
        estimate, ll = 0.0, ll_zero
        if not at_zero:
            inner, got, _, _, _ = em(x, (at[0], held(at[1], cell, leave), *at[2:]), rounds, tol, jump=False)
            if got[0] > ll:
                estimate, ll = float(inner[1][cell[0], cell[1], 0]), float(got[0])
        yield {**{c: row[c] for c in keys}, "at_boundary": at_zero, "estimate": estimate, "ll_max": ll, "ll_zero": ll_zero}

    return each_row(spread(models.join(series.select(*keys, "x"), keys), *keys), f"{key_schema(series, keys)}at_boundary boolean, estimate double, ll_max double, ll_zero double", of)


def profile(series: DataFrame, models: DataFrame, keys: list[str], cell: tuple[int, int], values, rounds: int = 5000, tol: float = 1e-8) -> DataFrame:
    """(keys, value, ll, drop): the likelihood with one transition held at each value, and twice its drop from the model's."""
    plan = models.join(series.select(*keys, "x"), keys).select(*models.columns, "x", F.explode(F.array(*map(F.lit, map(float, values)))).alias("value"))

    def of(row):
        ll = float(_constrained(np.asarray(row["x"], float), batch_of(row), cell, row["value"], rounds, tol)[1][0])
        yield {**{c: row[c] for c in keys}, "value": row["value"], "ll": ll, "drop": 2 * (row["ll"] - ll)}

    return each_row(spread(plan, *keys, "value"), f"{key_schema(models, keys)}value double, ll double, drop double", of)


def profile_bound(drops: DataFrame, keys: list[str], critical: float = 2.705543454095404) -> DataFrame:
    """Where the profile first reaches the critical value, by linear interpolation between grid values."""
    w = Window.partitionBy(*keys).orderBy("value")
    r = drops.withColumns({"_v": F.lag("value").over(w), "_d": F.lag("drop").over(w)}).where((F.col("_d") < critical) & (F.col("drop") >= critical))
    at = F.col("_v") + (critical - F.col("_d")) / (F.col("drop") - F.col("_d")) * (F.col("value") - F.col("_v"))
    return r.groupBy(*keys).agg(F.min(at).alias("upper"))


GRID = (0.001, 0.002, 0.004, 0.008, 0.015, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.45, 0.65, 0.9)


def refined_bound(series: DataFrame, models: DataFrame, keys: list[str], cell: tuple[int, int], critical: float = 2.705543454095404, grid=GRID, refine: int = 3, points: int = 8, rounds: int = 5000, tol: float = 1e-8) -> DataFrame:
    """(keys, estimate, upper, evaluated): the bound by a bracket on a grid of steps above the estimate, cut ``refine`` times at ``points`` places; null if the profile never gets that low."""

    def of(row):
        x, m = np.asarray(row["x"], float), batch_of(row)
        at = float(m[1][cell[0], cell[1], 0])
        values, drops = np.array([at]), np.array([0.0])
        new, upper = at + np.array(grid) * (1 - at), None
        for _ in range(refine + 1):
            ll = _constrained(x, m, cell, new, rounds, tol)[1]
            values, drops = np.append(values, new), np.append(drops, 2 * (row["ll"] - ll))
            order = np.argsort(values)
            values, drops = values[order], drops[order]
            over = np.flatnonzero(drops >= critical)
            if not len(over):
                break
            hi = max(int(over[0]), 1)
            lo = hi - 1
            share = (critical - drops[lo]) / (drops[hi] - drops[lo]) if drops[hi] > drops[lo] else 1.0
            upper = float(values[lo] + share * (values[hi] - values[lo]))
            new = np.linspace(values[lo], values[hi], points + 2)[1:-1]
        yield {**{c: row[c] for c in keys}, "estimate": at, "upper": upper, "evaluated": len(values) - 1}

    return each_row(spread(models.join(series.select(*keys, "x"), keys), *keys), f"{key_schema(models, keys)}estimate double, upper double, evaluated int", of)


def inverted_test(series: DataFrame, models: DataFrame, keys: list[str], cell: tuple[int, int], values, reps: int = 200, level: float = 0.9, seed: int = 22, rounds: int = 2000, tol: float = 1e-7, chunk: int = 25) -> DataFrame:
    """(keys, value, drop, critical, p, inside): for each value of a transition, the observed drop against those of paths simulated with it held there.

    ``critical`` is the ``level`` quantile of the simulated drops, p the share of them that reach the
    observed one; values inside belong to the confidence set.
    """
    joined = models.join(series.select(*keys, "x"), keys)
    plan = joined.select(*models.columns, "x", F.explode(F.array(*map(F.lit, map(float, values)))).alias("value"))

    def of(row):
        x, m, own = np.asarray(row["x"], float), batch_of(row), numbers(row["chunk"], reps, chunk)
        at, ll, _, _, _ = _constrained(x, m, cell, row["value"], rounds, tol)
        drop = 2 * (row["ll"] - float(ll[0]))
        paths = simulated(at[1][..., 0], at[2][:, 0], at[3][:, 0], len(x), [[seed, r, int(1e6 * row["value"])] for r in own])
        start, held_at = tuple(np.repeat(p, len(own), -1) for p in at), np.full(len(own), row["value"])
        zero = em(paths, start, rounds, tol, fixed=(cell, held_at))
        free = em(paths, zero[0], rounds, tol)
        for i in range(len(own)):
            yield {**{c: row[c] for c in keys}, "value": row["value"], "drop": drop, "simulated": float(2 * max(free[1][i] - zero[1][i], 0.0))}

    found = each_row(chunks(plan, [*keys, "value"], reps, chunk), f"{key_schema(models, keys)}value double, drop double, simulated double", of)
    out = found.groupBy(*keys, "value").agg(F.first("drop").alias("drop"), F.percentile("simulated", F.lit(level)).alias("critical"), F.avg((F.col("simulated") >= F.col("drop")).cast("double")).alias("p"))
    return out.withColumn("inside", F.col("drop") <= F.col("critical"))
