"""Regression, rank correlation, residual tests and resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.scan import numbered, overlapped, same, with_facts
from tidemark.operators.selection import correlations, quantiles  # noqa: F401


def hac_slope(rows: DataFrame, keys: list[str], y: str, x: str, order: str, lags: int = 20, piece: int = 100_000) -> DataFrame:
    """Least-squares slope with a Newey-West standard error (Bartlett weights) and its 95 % interval.

    Means and slope come from one aggregation; the scores' lagged products from ``lead`` within
    pieces of the numbered rows, each with the first rows of the next piece added, so that no window
    holds a whole series.
    """
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = with_facts(both, keys, F.avg(x).alias("_mx"), F.avg(y).alias("_my"), (F.covar_pop(y, x) / F.var_pop(x)).alias("_b"))
    r = r.withColumn("_u", (F.col(y) - F.col("_my")) - F.col("_b") * (F.col(x) - F.col("_mx"))).withColumn("_s", F.col("_u") * (F.col(x) - F.col("_mx")))
    at = numbered(r, keys, order).withColumn("_piece", F.floor(F.col("_i") / piece))
    early = (F.col("_piece") > 0) & (F.col("_i") % piece < lags)
    at = at.select("*", F.explode(F.when(early, F.array(F.col("_piece"), F.col("_piece") - 1)).otherwise(F.array("_piece"))).alias("_in"))
    w = Window.partitionBy(*keys, "_in").orderBy("_i")
    ahead = sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.lead("_s", k).over(w), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    g = at.withColumn("_m", F.col("_s") * (F.col("_s") + ahead)).where(F.col("_in") == F.col("_piece")).groupBy(*keys).agg(F.count("*").alias("n"), F.first("_b").alias("slope"), F.sum("_m").alias("_meat"), F.sum((F.col(x) - F.col("_mx")) ** 2).alias("_xx"))
    se = F.sqrt(F.greatest(F.col("_meat"), F.lit(0.0))) / F.col("_xx")
    return g.select(*keys, "n", "slope", se.alias("se"), (F.col("slope") - 1.96 * se).alias("lo"), (F.col("slope") + 1.96 * se).alias("hi"))


def jarque_bera(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n / 6 (S^2 + K^2 / 4) and its p-value exp(-JB / 2)."""
    g = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("excess_kurtosis"))
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("excess_kurtosis") ** 2 / 4)
    return g.withColumns({"jb": jb, "p": F.exp(-jb / 2)})


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution with an even number of degrees of freedom: exp(-x/2) sum (x/2)^i / i!."""
    half = x / 2
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest((df / 2).cast("int") - 1, F.lit(1))), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: F.struct((a["t"] * half / i).alias("t"), (a["s"] + a["t"] * half / i).alias("s")), lambda a: a["s"])
    return F.exp(-half) * F.when(df <= 2, 1.0).otherwise(terms)


def ljung_box(rows: DataFrame, keys: list[str], value: str, order: str, lags: Sequence[int] = (10, 24)) -> DataFrame:
    """(keys, lag, q, p): T (T + 2) sum rho_k^2 / (T - k), for even lags."""
    top = max(lags)
    r = overlapped(with_facts(rows, keys, F.avg(value).alias("_mean")).withColumn("_d", F.col(value) - F.col("_mean")), keys, order, behind=top)
    w = Window.partitionBy(*keys, "_in").orderBy("_i")
    r = r.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, top + 1)}).where(F.col("_in") == F.col("_block"))
    g = r.groupBy(*keys).agg(F.count("_d").alias("n"), F.sum(F.col("_d") ** 2).alias("_ss"), *(F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, top + 1)))
    q = lambda m: F.col("n") * (F.col("n") + 2) * sum(((F.col(f"_c{k}") / F.col("_ss")) ** 2 / (F.col("n") - k) for k in range(1, m + 1)), F.lit(0.0))
    out = g.select(*keys, "n", F.inline(F.array(*(F.struct(F.lit(m).alias("lag"), q(m).alias("q")) for m in lags))))
    return out.withColumn("p", chi2_sf(F.col("q"), F.col("lag")))


def arch_lm(rows: DataFrame, keys: list[str], value: str, order: str, lag: int = 12) -> DataFrame:
    """(keys, n, lm, f): T R^2 of squared values on their own ``lag`` lags; the normal equations are solved per key."""
    w = Window.partitionBy(*keys, "_in").orderBy("_i")
    r = overlapped(rows.select(*keys, order, (F.col(value) ** 2).alias("_y")), keys, order, behind=lag)
    r = r.withColumns({f"_x{k}": F.lag("_y", k).over(w) for k in range(1, lag + 1)}).where(F.col("_in") == F.col("_block")).dropna()
    names = ["_one", "_y", *(f"_x{k}" for k in range(1, lag + 1))]
    r = r.withColumn("_one", F.lit(1.0))
    # one row of cross products per key: the least squares needs no rows in Python
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    g = r.groupBy(*keys).agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in pairs))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def solve(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                m = np.array([[row[f"{a}{b}"] if (a, b) in set(pairs) else row[f"{b}{a}"] for b in names] for a in names])
                keep = [0, *range(2, len(names))]
                beta = np.linalg.lstsq(m[np.ix_(keep, keep)], m[keep, 1], rcond=None)[0]
                n, total = m[0, 0], m[1, 1] - m[0, 1] ** 2 / m[0, 0]
                left = m[1, 1] - beta @ m[keep, 1]
                r2 = 1 - left / total
                out.append({**{k: row[k] for k in keys}, "n": int(n), "lm": n * r2, "f": (r2 / lag) / ((1 - r2) / (n - lag - 1))})
            yield pd.DataFrame(out, columns=[*keys, "n", "lm", "f"])

    return g.mapInPandas(solve, f"{schema}{', ' if schema else ''}n long, lm double, f double")


def with_quantiles(rows: DataFrame, keys: list[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Adds _q, the key's quantiles as an array, found by counting."""
    found = quantiles(rows, keys, value, probs).select(*keys, F.col("q").alias("_q"))
    return same(rows, found, keys, "left") if keys else rows.crossJoin(found)  # one row


def winsorised(rows: DataFrame, keys: list[str], value: str, tail: float = 0.0005) -> DataFrame:
    """Adds ``capped``: the value clipped at its quantiles ``tail`` and 1 - ``tail`` per key."""
    r = with_quantiles(rows, keys, value, (tail, 1 - tail))
    return r.withColumn("capped", F.greatest(F.least(F.col(value), F.get("_q", F.lit(1))), F.get("_q", F.lit(0)))).drop("_q")


def sensitivity_variants(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each row under four variants: baseline, the largest set to the second largest, the largest (first of equals by ``order``) dropped, capped at the 99 % quantile."""
    largest = F.max_by(F.col(order), F.struct(F.col(value), -F.unix_micros(F.col(order).cast("timestamp")))) if dict(rows.dtypes)[order].startswith("timestamp") else F.max_by(F.col(order), F.struct(F.col(value), -F.col(order)))
    there = rows.where(F.col(value).isNotNull())
    r = with_facts(with_quantiles(there, keys, value, (0.99,)).withColumn("_cap", F.get("_q", F.lit(0))), keys, largest.alias("_at"))
    second = rows.where(F.col(value).isNotNull())
    second = with_facts(second, keys, largest.alias("_first")).where(F.col(order) != F.col("_first")).groupBy(*keys).agg(F.max(value).alias("_second")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    r = r.join(second, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left") if keys else r.crossJoin(second)
    v, top = F.col(value), F.col(order) == F.col("_at")
    made = lambda name, x: F.struct(F.lit(name).alias("variant"), x.alias("v"))
    out = r.select(*rows.columns, F.inline(F.array(made("baseline", v), made("max_to_second", F.when(top, F.col("_second")).otherwise(v)), made("drop_max", F.when(~top, v)), made("cap_q99", F.least(v, F.col("_cap"))))).alias("variant", "_v"))
    return out.where("_v is not null").drop(value).withColumnRenamed("_v", value)


def upper_tail_variants(rows: DataFrame, keys: list[str], value: str, order: str, start: str, after: str) -> DataFrame:
    """Each row under two variants: what lies over the 99 % quantile capped between ``start`` and ``after`` only, and all of it capped, from ``after`` on."""
    r = with_quantiles(rows.where(F.col(value).isNotNull()), keys, value, (0.99,)).withColumn("_cap", F.get("_q", F.lit(0)))
    late = F.col(order) >= F.lit(after).cast(dict(rows.dtypes)[order])
    within = (F.col(order) >= F.lit(start).cast(dict(rows.dtypes)[order])) & ~late
    capped = F.least(F.col(value), F.col("_cap"))
    made = lambda name, x: F.struct(F.lit(name).alias("variant"), x.alias("v"))
    out = r.select(*rows.columns, F.inline(F.array(made("tail_capped_within", F.when(within, capped).otherwise(F.col(value))), made("capped_from", F.when(late, capped)))).alias("variant", "_v"))
    return out.where("_v is not null").drop(value).withColumnRenamed("_v", value)


def residual_battery(rows: DataFrame, keys: list[str], value: str, order: str, lags: Sequence[int] = (10, 24), arch_lag: int = 12, trim: int = 5) -> DataFrame:
    """(keys, test, lag, statistic, p): Ljung-Box of the residuals, their squares, sizes and log squares, ARCH of all and without the ``trim`` largest, Jarque-Bera."""
    z = F.col(value)
    kinds = {"z": z, "squares": z * z, "sizes": F.abs(z), "log_squares": F.ln(F.greatest(z * z, F.lit(1e-300)))}
    long = rows.select(*keys, order, F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("_z")) for k, v in kinds.items()))))
    boxes = ljung_box(long, [*keys, "kind"], "_z", order, lags).select(*keys, F.concat(F.lit("ljung_box_"), "kind").alias("test"), "lag", F.col("q").alias("statistic"), "p")
    arch = lambda r, name: arch_lm(r, keys, value, order, arch_lag).select(*keys, F.lit(name).alias("test"), F.lit(arch_lag).alias("lag"), F.col("lm").alias("statistic"), chi2_sf(F.col("lm"), F.lit(arch_lag)).alias("p"))
    jb = jarque_bera(rows, keys, value).select(*keys, F.lit("jarque_bera").alias("test"), F.lit(0).alias("lag"), F.col("jb").alias("statistic"), "p")
    return boxes.unionByName(arch(rows, "arch")).unionByName(arch(trimmed(rows, keys, value, order, trim), "arch_trimmed")).unionByName(jb)


def injected(rows: DataFrame, keys: list[str], value: str, order: str, put: float, positions: Sequence[int]) -> DataFrame:
    """Each row once per position; in the copy of a position the row there (from 0) has the value ``put``."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    r = rows.withColumn("_i", at).select("*", F.explode(F.array(*map(F.lit, positions))).alias("position"))
    return r.withColumn(value, F.when(F.col("_i") == F.col("position"), put).otherwise(F.col(value))).drop("_i")


def trimmed(rows: DataFrame, keys: list[str], value: str, order: str, drop: int) -> DataFrame:
    """Without the ``drop`` rows largest in size per key; ties go by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs(F.col(value))), order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > drop).drop("_r")


def gaussian_fit(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, variance and log-likelihood of one Gaussian, with AIC and BIC."""
    g = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mu"), F.var_pop(value).alias("var"))
    ll = -F.col("n") / 2 * (math.log(2 * math.pi) + 1 + F.ln("var"))
    return g.withColumns({"loglik": ll, "aic": 4 - 2 * ll, "bic": 2 * F.ln("n") - 2 * ll})


def block_bootstrap_median(rows: DataFrame, keys: list[str], value: str, order: str, block: int = 24, reps: int = 2000, level: float = 0.95, seed: int = 1, chunk: int = 100) -> DataFrame:
    """(keys, n, median, lo, hi): percentile interval of the median under moving blocks of ``block`` rows.

    The replicates of a key are dealt to tasks in chunks, each with the key's series (sorted) and
    its own seeds, so the result does not depend on the partitioning. A key's series must fit a task.
    """
    series = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("x"))
    tasks = series.select(*keys, "x", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // chunk))).alias("chunk"))
    tasks = tasks.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "chunk", *keys)  # by number: few, small, costly rows
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def draw(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                x = np.asarray(row.x, float)
                n, width = len(x), min(block, len(x))
                todo = range(row.chunk * chunk, min(reps, (row.chunk + 1) * chunk))
                out = []
                for r in todo:
                    at = np.random.default_rng([seed, r]).integers(0, n - width + 1, -(-n // width))
                    out.append(np.median(x[(at[:, None] + np.arange(width)).ravel()[:n]]))
                yield pd.DataFrame({**{k: [getattr(row, k)] * len(out) for k in keys}, "draw": out})

    drawn = tasks.mapInPandas(draw, f"{schema}{', ' if schema else ''}draw double")
    tail = (1 - level) / 2
    g = drawn.groupBy(*keys).agg(F.percentile("draw", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    point = series.select(*keys, F.size("x").alias("n"), F.element_at(F.array_sort("x"), (F.size("x") / 2).cast("int") + 1).alias("_u"), F.element_at(F.array_sort("x"), ((F.size("x") + 1) / 2).cast("int")).alias("_d"))
    return point.join(g, keys).select(*keys, "n", ((F.col("_u") + F.col("_d")) / 2).alias("median"), F.get("_q", F.lit(0)).alias("lo"), F.get("_q", F.lit(1)).alias("hi"))
