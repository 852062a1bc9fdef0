"""Sequential computations over series of any length: blocks, their summaries, and what is carried from block to block.

The rows of a key are numbered in order and cut into blocks of ``size`` rows. A block is reduced to
a summary of fixed size by whichever task holds it; ``chained`` walks over the few summaries of a
key in order and hands every block what the blocks before it (or, backwards, after it) come to;
then each block is finished by itself. No task ever holds a series, only blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from tidemark.operators import chain
from tidemark.session import cut

SIZE = 10_000


def stretch_of(rows: DataFrame, order: str) -> Column:
    """A coarse part of the order column: days of stamps, 100,000s of numbers. Windows within it stay small however long a series is."""
    kind = dict(rows.dtypes)[order]
    return F.date_trunc("day", order).cast("string") if kind.startswith(("timestamp", "date")) else F.lpad(F.floor(F.col(order) / 100_000).cast("string"), 20, "0")


def numbered(rows: DataFrame, keys: list[str], order: str, name: str = "_i") -> DataFrame:
    """Adds each row's place (from 0) in its key's order: places within stretches, plus the rows of the stretches before."""
    r = rows.withColumn("_stretch", stretch_of(rows, order))
    before = r.groupBy(*keys, "_stretch").agg(F.count("*").alias("_n")).withColumn("_head", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)))
    named = before.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_stretch").alias("_of"), F.coalesce("_head", F.lit(0)).alias("_head"))
    same = F.col("_stretch") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy(order)) - 1
    return r.withColumn("_own", own).join(named, same).withColumn(name, F.col("_own") + F.col("_head")).drop("_own", "_head", "_stretch", "_of", *(f"_k{i}" for i in range(len(keys))))


def with_facts(rows: DataFrame, keys: list[str], *facts: Column) -> DataFrame:
    """Adds facts of each key, computed by one aggregation and joined back: no window holds a whole key."""
    found = rows.groupBy(*keys).agg(*facts)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    named = found.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    return (rows.join(named, same) if keys else rows.crossJoin(named)).drop(*(f"_k{i}" for i in range(len(keys))))


def blocked(rows: DataFrame, keys: list[str], order: str, size: int = SIZE) -> DataFrame:
    """Adds _i, each row's place (from 0) in its key's order, and _block, its place over ``size``."""
    return numbered(rows, keys, order).withColumn("_block", F.floor(F.col("_i") / size))


def packed(rows: DataFrame, keys: list[str], order: str, names: list[str], size: int = SIZE) -> DataFrame:
    """A row per block: (keys, _block, rows), the block's rows as structs of place _i and the named columns, in order."""
    own = F.array_sort(F.collect_list(F.struct("_i", *names)))
    return blocked(rows.select(*keys, order, *(n for n in names if n not in (*keys, order))), keys, order, size).groupBy(*keys, "_block").agg(own.alias("rows"))


def fields(frame: DataFrame, *names: str) -> str:
    """The named columns of a table as a schema text, with a comma behind each."""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.select(*names).schema)


def each(frame: DataFrame, schema: str, of: Callable[[dict], list[dict]], rows: int = 16) -> DataFrame:
    """``of`` gives the rows that come of one row, as dicts; a batch of ``rows`` is made at a time."""
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = [x for row in batch.slice(at, rows).to_pylist() for x in of(row)]
                yield from pa.Table.from_pylist(got, schema=arrow()).to_batches()

    return frame.mapInArrow(run, schema)


def arrow_schema(schema: str) -> Callable:
    """The Arrow schema of a schema text, made where it is called."""
    json = StructType.fromDDL(schema).json()

    def made():
        from json import loads

        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(StructType.fromJson(loads(json)))

    return made


def chained(summaries: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str, backwards: bool = False) -> DataFrame:
    """Walks over the summaries of each key in order: ``step(row, state)`` gives (row's result as dict, next state).

    ``state`` is None at the first row of a key. Summaries are few, a row per block, and pass as a
    sorted stream: only the state is kept. ``schema``: the columns of the results, keys and order first.
    """
    arrow = arrow_schema(schema)
    by = [F.col(k).asc_nulls_first() for k in keys] + [F.col(o).desc_nulls_last() if backwards else F.col(o).asc_nulls_first() for o in order]
    dealt = summaries.repartition(*keys) if keys else summaries.coalesce(1)  # of one series: few rows

    def run(batches):
        import pyarrow as pa

        last, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != last:
                    last, state = own, None
                got, state = step(row, state)
                out.append({**{k: row[k] for k in (*keys, *order)}, **got})
            yield from pa.Table.from_pylist(out, schema=arrow()).to_batches()

    return dealt.sortWithinPartitions(*by).mapInArrow(run, schema)


def same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join by the named columns, nulls equal; the right side's are dropped."""
    named = right.withColumnsRenamed({n: f"_same{i}" for i, n in enumerate(names)})
    on = F.lit(True)
    for i, n in enumerate(names):
        on = on & F.col(n).eqNullSafe(F.col(f"_same{i}"))
    return left.join(named, on, how).drop(*(f"_same{i}" for i in range(len(names))))


# last known values ---------------------------------------------------------------------------


def carried(rows: DataFrame, keys: list[str], order: str, back: dict[str, Column] | None = None, ahead: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, size: int = SIZE) -> DataFrame:
    """Adds, per named mark of ``back``, its last value that is not null before the row; per mark of ``ahead`` the next one after it; per term of ``sums`` its sum up to the row, nulls as 0.

    Within a block by windows; across blocks by the marks at the blocks' ends and the blocks' sums,
    carried over one summary row per block. Rows that are blocked already keep their places.
    """
    back, ahead, sums = back or {}, ahead or {}, sums or {}
    known = "_block" in rows.columns
    r = rows if known else blocked(rows, keys, order, size)
    r = r.withColumns({f"_m_{n}": c for n, c in {**back, **ahead}.items()} | {f"_m_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    there = lambda n: F.when(F.col(f"_m_{n}").isNotNull(), F.col("_i"))
    ends = r.groupBy(*keys, "_block").agg(*(F.max_by(f"_m_{n}", there(n)).alias(f"_e_{n}") for n in back), *(F.min_by(f"_m_{n}", there(n)).alias(f"_e_{n}") for n in ahead), *(F.sum(f"_m_{n}").alias(f"_e_{n}") for n in sums))
    near, far = Window.partitionBy(*keys, "_block"), Window.partitionBy(*keys)
    up = lambda w, o, to: w.orderBy(o).rowsBetween(Window.unboundedPreceding, to)
    sides = [(n, F.col("_i"), F.col("_block")) for n in back] + [(n, F.col("_i").desc(), F.col("_block").desc()) for n in ahead]
    ends = ends.select(*keys, "_block", *(F.last(f"_e_{n}", True).over(up(far, o, -1)).alias(f"_f_{n}") for n, _, o in sides), *(F.sum(f"_e_{n}").over(up(far, F.col("_block"), -1)).alias(f"_f_{n}") for n in sums))
    r = r.withColumns({f"_n_{n}": F.last(f"_m_{n}", True).over(up(near, o, -1)) for n, o, _ in sides} | {f"_n_{n}": F.sum(f"_m_{n}").over(up(near, F.col("_i"), 0)) for n in sums})
    both = same(r, ends, [*keys, "_block"])
    both = both.withColumns({n: F.coalesce(f"_n_{n}", f"_f_{n}") for n, *_ in sides} | {n: F.coalesce(f"_f_{n}", F.lit(0)) + F.col(f"_n_{n}") for n in sums})
    both = both.drop(*(f"_{p}_{n}" for p in "mnf" for n in (*back, *ahead, *sums)))
    return both if known else both.drop("_i", "_block")


def segments(rows: DataFrame, keys: list[str], order: str, value: Column, name: str = "segment", size: int = SIZE) -> DataFrame:
    """Adds the running number, from 1, of the stretches of one value (null is a value too).

    A block's summary is its first and last value and its number of changes; whether a block's first
    row begins a stretch depends on the last value of the block before.
    """
    known = "_block" in rows.columns
    r = (rows if known else blocked(rows, keys, order, size)).withColumn("_v", F.struct(value.alias("v")))
    near, far = Window.partitionBy(*keys, "_block").orderBy("_i"), Window.partitionBy(*keys).orderBy("_block")
    before = F.lag("_v").over(near)
    r = r.withColumn("_c", F.when(before.isNotNull() & ~F.col("_v").eqNullSafe(before), 1).otherwise(0))
    ends = r.groupBy(*keys, "_block").agg(F.min_by("_v", "_i").alias("_a"), F.max_by("_v", "_i").alias("_z"), F.sum("_c").alias("_n"))
    ends = ends.withColumn("_new", (~F.col("_a").eqNullSafe(F.lag("_z").over(far))).cast("int"))
    ends = ends.select(*keys, "_block", (F.coalesce(F.sum(F.col("_n") + F.col("_new")).over(far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_new")).alias("_h"))
    both = same(r.withColumn("_o", F.sum("_c").over(near.rowsBetween(Window.unboundedPreceding, 0))), ends, [*keys, "_block"])
    both = both.withColumn(name, F.col("_h") + F.col("_o")).drop("_v", "_c", "_h", "_o")
    return both if known else both.drop("_i", "_block")


def overlapped(rows: DataFrame, keys: list[str], order: str, behind: int = 0, ahead: int = 0, size: int = SIZE) -> DataFrame:
    """Blocked rows once more in every block whose rows look at them, up to ``behind`` rows back or ``ahead`` rows on: windows by (keys, _in), ordered by _i.

    A row's own copy is the one with _in = _block; ``behind`` and ``ahead`` may exceed ``size``.
    """
    i = F.col("_i")
    of = lambda place: F.floor(place / size)
    return blocked(rows, keys, order, size).withColumn("_in", F.explode(F.sequence(of(F.greatest(i - ahead, F.lit(0))), of(i + behind)))).where((F.col("_in") * size <= i + behind) & ((F.col("_in") + 1) * size > i - ahead))


# linear recurrences --------------------------------------------------------------------------


def recurrence(rows: DataFrame, keys: list[str], order: str, shift: str, factor: str, start: float = 0.0, name: str = "level", size: int = SIZE) -> DataFrame:
    """(keys, order, name): h = shift + factor * h of the row before, with ``start`` before the first row.

    The maps of a block are composed to one, its reach; the reaches are carried over; every block
    is then run from the level that it starts with. Null shifts and factors count as 0 and 1, so
    that such a row repeats the level.
    """
    clean = rows.select(*keys, order, F.coalesce(F.col(shift).cast("double"), F.lit(0.0)).alias("_a"), F.coalesce(F.col(factor).cast("double"), F.lit(1.0)).alias("_b"))
    blocks = cut(packed(clean, keys, order, [order, "_a", "_b"], size))
    one = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    reach = F.aggregate("rows", one, lambda acc, r: F.struct((r["_a"] + r["_b"] * acc["a"]).alias("a"), (r["_b"] * acc["b"]).alias("b")))
    head = fields(blocks, *keys, "_block")
    ends = chained(blocks.select(*keys, "_block", reach.alias("_m")), keys, ["_block"], lambda row, state: ({"_from": (h := start if state is None else state)}, row["_m"]["a"] + row["_m"]["b"] * h), head + "_from double")
    kind = dict(rows.dtypes)[order]

    def run(row):
        h, out = row["_from"], []
        for r in row["rows"]:
            h = r["_a"] + r["_b"] * h
            out.append({**{k: row[k] for k in keys}, order: r[order], name: h})
        return out

    return each(same(blocks, ends, [*keys, "_block"]), f"{fields(rows, *keys)}`{order}` {kind}, `{name}` double", run)


# hidden chains -------------------------------------------------------------------------------

MODEL = ("pi", "a", "mu", "sigma")


def _steps(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pi, a, densities (k, t) divided by the largest of their time, logs of those divisors."""
    pi, a, mu, sigma = (np.array(row[n], float) for n in MODEL)
    x = np.array([r["x"] for r in row["rows"]], float)
    log = -0.5 * ((x[None] - mu[:, None]) / sigma[:, None]) ** 2 - np.log(sigma)[:, None] - 0.5 * np.log(2 * np.pi)
    top = log.max(0)
    return pi, a, np.exp(log - top), top


def _run(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Causal probabilities (k, members, t) of a block and the logs of all weight, from weights (k, members) of its first row."""
    steps = np.repeat((a[..., None] * b[None, :, 1:])[:, :, None], first.shape[1], 2)
    return chain.forward(first, steps)


def series_blocks(rows: DataFrame, keys: list[str], value: str, order: str, size: int = SIZE) -> DataFrame:
    """(keys, _block, rows of x): the blocks of each key's values that are not null."""
    return cut(packed(rows.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("double").alias("x")), keys, order, [order, "x"], size))


def transfers(blocks: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _block, m, log): each block's product of steps, k x k, as weights per first state that sum to at most 1, and the log of what they were divided by."""
    head = fields(blocks, *keys, "_block")

    def run(row):
        pi, a, b, top = _steps(row)
        rows_, log = _run(np.diag(b[:, 0]), a, b)  # a member per first state
        most = log[:, -1].max()
        m = rows_[:, :, -1].T * np.exp(log[:, -1] - most)[:, None]
        return [{**{k: row[k] for k in (*keys, "_block")}, "m": m.tolist(), "log": float(most + top.sum()), "pi": pi.tolist(), "a": a.tolist()}]

    return each(same(blocks, models.select(*keys, *MODEL), keys), head + "m array<array<double>>, log double, pi array<double>, a array<array<double>>", run)


def edges(products: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _block, before, prior, after, ll): what each block gets from those before it and after it.

    ``before``: probabilities of the states at the row before the block (null for the first);
    ``prior``: of those at its first row, by the rows before; ``after``: what the states of its
    last row make of all rows after it, up to a factor; ``ll``: the log-likelihood up to its end.
    """
    head, products = fields(products, *keys, "_block"), cut(products)

    def forth(row, state):
        before, ll = (None, 0.0) if state is None else state
        prior = np.array(row["pi"]) if before is None else before @ np.array(row["a"])
        end = prior @ np.array(row["m"])
        ll += row["log"] + float(np.log(max(end.sum(), chain.LEAST)))
        end = end / max(end.sum(), chain.LEAST)
        return {"before": None if before is None else before.tolist(), "prior": prior.tolist(), "ll": ll}, (end, ll)

    def back(row, state):
        after = np.ones(len(row["pi"])) if state is None else state
        own = np.array(row["a"]) @ (np.array(row["m"]) @ after)
        return {"after": after.tolist()}, own / max(own.max(), chain.LEAST)

    first = chained(products, keys, ["_block"], forth, head + "before array<double>, prior array<double>, ll double")
    last = chained(products, keys, ["_block"], back, head + "after array<double>", backwards=True)
    return same(first, last, [*keys, "_block"])


def _finished(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """alpha (k, t), gamma (k, t), pairs (k, k) with the one from the row before, one-step priors (k, t)."""
    pi, a, b, _ = _steps(row)
    prior, after = np.array(row["prior"]), np.array(row["after"])
    alpha, _ = _run((prior * b[:, 0])[:, None], a, b)
    steps = (a[..., None] * b[None, :, 1:])[:, :, None]
    turned, _ = chain.forward(after[:, None], np.swapaxes(steps[..., ::-1], 0, 1))
    beta = turned[..., ::-1]
    gamma, pairs = chain.smoothed(alpha, beta, steps)
    total = pairs.sum(3)[..., 0]
    if row["before"] is not None:
        into = np.array(row["before"])[:, None] * a * (b[:, 0] * beta[:, 0, 0])[None]
        total = total + into / max(into.sum(), chain.LEAST)
    alpha = alpha[:, 0]
    return alpha, gamma[:, 0], total, np.column_stack([prior, a.T @ alpha[:, :-1]])


def chain_states(rows: DataFrame, models: DataFrame, keys: list[str], value: str, order: str, size: int = SIZE) -> DataFrame:
    """(keys, order, x, filtered, smoothed, mean, var): causal and two-sided probabilities of the states, one-step forecasts.

    ``models``: a row per key with pi, a, mu and sigma. Keys without a model are left out, rows with a null value too.
    """
    blocks = series_blocks(rows, keys, value, order, size)
    around = edges(transfers(blocks, models, keys), keys).drop("ll")
    kind = dict(rows.dtypes)[order]

    def run(row):
        mu, sigma = np.array(row["mu"]), np.array(row["sigma"])
        alpha, gamma, _, ahead = _finished(row)
        mean = mu @ ahead
        var = (sigma**2 + mu**2) @ ahead - mean**2
        return [{**{k: row[k] for k in keys}, order: r[order], "x": r["x"], "filtered": alpha[:, t].tolist(), "smoothed": gamma[:, t].tolist(), "mean": mean[t], "var": var[t]} for t, r in enumerate(row["rows"])]

    all_ = same(same(blocks, models.select(*keys, *MODEL), keys), around, [*keys, "_block"])
    return each(all_, f"{fields(rows, *keys)}`{order}` {kind}, x double, filtered array<double>, smoothed array<double>, mean double, var double", run)


def chain_loglik(blocks: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ll): the log-likelihood of each key's series."""
    return edges(transfers(blocks, models, keys), keys).groupBy(*keys).agg(F.max_by("ll", "_block").alias("ll"))


def em_step(blocks: DataFrame, models: DataFrame, keys: list[str], least_var: float = 1e-12) -> DataFrame:
    """(keys, pi, a, mu, sigma, ll): one step of EM from ``models``, and the log-likelihood of the model that went in.

    Each block gives its sums; they are added per key by one aggregation, as arrays of k and k x k
    numbers. A state that no row visits keeps its mean, deviation and transitions.
    """
    around = edges(transfers(blocks, models, keys), keys)
    all_ = same(same(blocks, models.select(*keys, *MODEL), keys), around, [*keys, "_block"])
    head = fields(blocks, *keys, "_block")

    def run(row):
        x = np.array([r["x"] for r in row["rows"]], float)
        _, gamma, pairs, _ = _finished(row)
        out = []
        for k in range(len(gamma)):  # a row per state: its sums add up in the JVM; squares around the old mean
            d = x - row["mu"][k]
            out.append({**{n: row[n] for n in (*keys, "_block")}, "s": k, "pi": row["pi"][k], "a": row["a"][k], "mu": row["mu"][k], "sigma": row["sigma"][k], "ll": row["ll"], "g0": float(gamma[k, 0]), "n": float(gamma[k].sum()), "d1": float(gamma[k] @ d), "d2": float(gamma[k] @ (d * d)), "pairs": pairs[k].tolist()})
        return out

    sums = each(all_, head + "s int, pi double, a array<double>, mu double, sigma double, ll double, g0 double, n double, d1 double, d2 double, pairs array<double>", run)
    added = sums.select("*", F.posexplode("pairs").alias("_to", "_p")).groupBy(*keys, "s", "_to").agg(
        F.sum("_p").alias("_p"), F.sum("n").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"), F.max_by("ll", "_block").alias("ll"), F.min_by("g0", "_block").alias("g0"), F.first("mu").alias("mu"), F.first("sigma").alias("sigma"), F.first("a").alias("a")
    )
    state = added.groupBy(*keys, "s").agg(F.transform(F.array_sort(F.collect_list(F.struct("_to", "_p"))), lambda p: p["_p"]).alias("_row"), *(F.first(n).alias(n) for n in ("n", "d1", "d2", "ll", "g0", "mu", "sigma", "a")))
    some, left = F.col("n") > 1e-300, F.aggregate("_row", F.lit(0.0), lambda acc, p: acc + p)
    move = F.when(some, F.col("d1") / F.col("n")).otherwise(0.0)
    state = state.select(
        *keys, "s", "ll", F.col("g0").alias("pi"), F.when(left > 1e-300, F.transform("_row", lambda p: p / left)).otherwise(F.col("a")).alias("a"), (F.col("mu") + move).alias("mu"),
        F.when(some, F.sqrt(F.greatest(F.col("d2") / F.col("n") - move * move, F.lit(least_var)))).otherwise(F.col("sigma")).alias("sigma"),
    )
    row = F.array_sort(F.collect_list(F.struct("s", "pi", "a", "mu", "sigma")))
    return state.groupBy(*keys).agg(F.first("ll").alias("ll"), row.alias("_r")).select(*keys, *(F.col("_r")[n].alias(n) for n in MODEL), "ll")


def fit(blocks: DataFrame, models: DataFrame, keys: list[str], rounds: int = 500, tol: float = 1e-6) -> DataFrame:
    """(keys, pi, a, mu, sigma, ll, rounds): EM from ``models`` until no key gains more than ``tol``, or for ``rounds``; ll is that of the model.

    Every round is one pass over all blocks of all keys; models and likelihoods stay in tables, and
    only the largest gain comes to the driver.
    """
    now, before, made = models.select(*keys, *MODEL), None, 0
    while True:
        step = cut(em_step(blocks, now, keys))
        gain = None
        if before is not None:
            told = same(step.select(*keys, F.col("ll").alias("_now")), before.select(*keys, F.col("ll").alias("_then")), keys)
            gain = told.agg(F.max(F.col("_now") - F.col("_then"))).first()[0]
        if made == rounds or (gain is not None and gain <= tol) or (before is not None and gain is None):
            return same(now, step.select(*keys, "ll"), keys).withColumn("rounds", F.lit(made))
        now, before, made = step.select(*keys, *MODEL), step, made + 1


def likely_path(rows: DataFrame, models: DataFrame, keys: list[str], value: str, order: str, size: int = SIZE) -> DataFrame:
    """(keys, order, state): the jointly most probable states; of equals the smaller state.

    The same scan with the best path instead of the sum of all: per block the best score from each
    first to each last state; carried over, they give the scores before each block; a block then
    knows from which state before it each of its last states comes; these pointers are followed
    backwards over the blocks; and each block tells its own path to its own last state.
    """
    blocks = same(series_blocks(rows, keys, value, order, size), models.select(*keys, *MODEL), keys)
    head, kind = fields(blocks, *keys, "_block"), dict(rows.dtypes)[order]

    def logs(row):
        pi, a, mu, sigma = (np.array(row[n], float) for n in MODEL)
        x = np.array([r["x"] for r in row["rows"]], float)
        b = -0.5 * ((x[:, None] - mu) / sigma) ** 2 - np.log(sigma) - 0.5 * np.log(2 * np.pi)
        return np.log(np.maximum(pi, chain.LEAST)), np.log(np.maximum(a, chain.LEAST)), b

    def best(row):
        pi, a, b = logs(row)
        score = np.where(np.eye(len(pi), dtype=bool), b[0][None], -np.inf)  # first state x state
        for t in range(1, len(b)):
            score = (score[:, :, None] + a[None]).max(1) + b[t]
        return [{**{k: row[k] for k in (*keys, "_block")}, "m": score.tolist(), "pi": pi.tolist(), "a": a.tolist()}]

    def forth(row, state):
        prior = np.array(row["pi"]) if state is None else (state[:, None] + np.array(row["a"])).max(0)
        end = (prior[:, None] + np.array(row["m"])).max(0)
        return {"before": None if state is None else state.tolist()}, end

    def within(row):
        """Back pointers of each row, those of the first into the block before, and the last scores."""
        pi, a, b = logs(row)
        back = np.zeros(b.shape, np.int8)
        score = pi + b[0]
        if row["before"] is not None:
            step = np.array(row["before"])[:, None] + a
            back[0], score = step.argmax(0), step.max(0) + b[0]
        for t in range(1, len(b)):
            step = score[:, None] + a
            back[t], score = step.argmax(0), step.max(0) + b[t]
        return back, score

    def pointers(row):
        back, score = within(row)
        came = np.arange(back.shape[1])
        for t in range(len(back) - 1, -1, -1):
            came = back[t, came]
        return [{**{k: row[k] for k in (*keys, "_block")}, "came": came.tolist(), "best": int(score.argmax())}]

    def follow(row, state):
        end = row["best"] if state is None else state
        return {"end": end}, row["came"][end]

    def path(row):
        back, _ = within(row)
        at, out = row["end"], []
        for t in range(len(back) - 1, -1, -1):
            out.append({**{k: row[k] for k in keys}, order: row["rows"][t][order], "state": int(at)})
            at = back[t, at]
        return out[::-1]

    scored = each(blocks, head + "m array<array<double>>, pi array<double>, a array<array<double>>", best)
    known = cut(same(blocks, chained(scored, keys, ["_block"], forth, head + "before array<double>"), [*keys, "_block"]))
    ends = chained(each(known, head + "came array<int>, best int", pointers), keys, ["_block"], follow, head + "end int", backwards=True)
    return each(same(known, ends, [*keys, "_block"]), f"{fields(rows, *keys)}`{order}` {kind}, state int", path)
