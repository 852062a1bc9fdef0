"""Counts at an exact floor, and quantiles of values that are hidden inside a band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.scan import same
from tidemark.operators.selection import quantiles


def floor_counts(rows: DataFrame, keys: list[str], rate: Column, floor: Column) -> DataFrame:
    """Per key: records below, at and above the floor by exact comparison, and their shares."""
    side = lambda c: F.count_if(c)
    g = rows.groupBy(*keys).agg(F.count(rate).alias("n"), side(rate < floor).alias("below"), side(rate == floor).alias("at"), side(rate > floor).alias("above"))
    return g.where("n > 0").withColumns({f"share_{k}": F.col(k) / F.col("n") for k in ("below", "at", "above")})


def phase_shares(rows: DataFrame, keys: list[str], at_floor: Column, phase: Column) -> DataFrame:
    """Share at the floor by phase, with the smallest and largest over the key's phases."""
    g = rows.groupBy(*keys, phase.alias("phase")).agg(F.count("*").alias("n"), F.avg(at_floor.cast("double")).alias("share"))
    w = Window.partitionBy(*keys)
    return g.withColumns({"smallest": F.min("share").over(w), "largest": F.max("share").over(w)})


def censored_quantiles(rows: DataFrame, keys: list[str], value: str, probs: Sequence[float] = (0.25, 0.5, 0.75), inside: float = 1.0, plain: bool = False) -> DataFrame:
    """(keys, p, q, n): linear-interpolated quantiles where nulls stand inside the band.

    A null sorts at ``inside``; a quantile is null if one of the two order statistics that it
    lies between, with a weight, is hidden. Values are first counted, so the ranking handles
    distinct values, and a rank range is looked up instead of a row. ``plain``: nulls are left out,
    and both order statistics are weighted and added with one rounding, as SQL's quantile_cont does.
    """
    counted = (rows.where(F.col(value).isNotNull()) if plain else rows).groupBy(*keys, F.coalesce(F.col(value), F.lit(inside)).alias("_v"), F.col(value).isNull().alias("_hidden")).count()
    order = Window.partitionBy(*keys).orderBy("_v", "_hidden")
    upto = counted.withColumns({"_hi": F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("count").over(Window.partitionBy(*keys))})
    at = upto.withColumn("_lo", F.col("_hi") - F.col("count"))
    at = at.select("*", F.explode(F.array(*map(F.lit, probs))).alias("p")).withColumn("_h", (F.col("n") - 1) * F.col("p"))
    slack = 0.0 if plain else 1e-12
    down, up = F.floor(F.col("_h") + slack), F.ceil(F.col("_h") - slack)
    hit = lambda r: (F.col("_lo") <= r) & (r < F.col("_hi"))
    at = at.where(hit(down) | hit(up))
    g = at.groupBy(*keys, "p").agg(F.max(F.when(hit(down), F.col("_v"))).alias("_a"), F.max(F.when(hit(up), F.col("_v"))).alias("_b"), F.max("_hidden").alias("_any"), F.max("_h").alias("_h"), F.max("n").alias("n"))
    share = F.col("_h") - down
    if plain:
        between = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), F.col("_a"), 1 - share, F.col("_b") * share).cast("double")
    else:
        between = F.col("_a") + (F.col("_b") - F.col("_a")) * share
    return g.select(*keys, "p", F.when(~F.col("_any"), F.when(down == up, F.col("_a")).otherwise(between) if plain else between).alias("q"), "n")


def wide_quantiles(q: DataFrame, keys: list[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles as columns p25, p50, ..."""
    return q.groupBy(*keys).agg(*(F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"p{round(100 * p):02d}") for p in probs))


def location(rows: DataFrame, keys: list[str], value: str, lo: float = -4.0, hi: float = 6.0) -> DataFrame:
    """n, mean, standard deviation and share in the closed band, of the values that are there."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.avg(F.when(v.isNotNull(), v.between(lo, hi).cast("double"))).alias("share_in_band"))


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd (n - 1), min, median, max, skewness and excess kurtosis (both of the population); nulls and non-finite values are left out."""
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    g = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("excess_kurtosis"))
    middle = quantiles(rows.select(*keys, v.alias("_v")), keys, "_v", (0.5,)).select(*keys, F.get("q", F.lit(0)).alias("median"))
    both = same(g, middle, keys, "left") if keys else g.join(middle, F.lit(True), "left")  # one row each
    return both.select(*keys, "n", "mean", "sd", "min", "median", "max", "skew", "excess_kurtosis")


def floor_summary_by_period(rows: DataFrame, keys: list[str], levels: dict[str, Column], rate: Column, floor: Column) -> DataFrame:
    """Floor counts for several levels of the calendar in one pass: (keys, level, period, n, below, at, above).

    Every row is counted once per level by GROUPING SETS over the level columns.
    """
    wide = rows.withColumns({f"_{k}": c for k, c in levels.items()}).withColumn("_rate", rate).withColumn("_floor", floor)
    names = [f"_{k}" for k in levels]
    g = wide.groupingSets([[*keys, n] for n in names], *keys, *names)
    out = g.agg(F.count("_rate").alias("n"), F.count_if(F.col("_rate") < F.col("_floor")).alias("below"), F.count_if(F.col("_rate") == F.col("_floor")).alias("at"), F.count_if(F.col("_rate") > F.col("_floor")).alias("above"), *(F.grouping(n).alias(f"g{n}") for n in names))
    level = F.coalesce(*(F.when(F.col(f"g_{k}") == 0, k) for k in levels))
    return out.select(*keys, level.alias("level"), F.coalesce(*(F.when(F.col(f"g_{k}") == 0, F.col(f"_{k}")) for k in levels)).alias("period"), "n", "below", "at", "above")


def rank_against(shares: DataFrame, keys: list[str], me: str, name: str = "venue", value: str = "share") -> DataFrame:
    """Where one venue's share stands against all others: above_all, below_all or between."""
    mine = F.max(F.when(F.col(name) == me, F.col(value)))
    rest = F.when(F.col(name) != me, F.col(value))
    g = shares.groupBy(*keys).agg(mine.alias("mine"), F.min(rest).alias("lowest"), F.max(rest).alias("highest"))
    return g.withColumn("rank", F.when(F.col("mine") > F.col("highest"), "above_all").when(F.col("mine") < F.col("lowest"), "below_all").when(F.col("mine").isNotNull() & F.col("lowest").isNotNull(), "between"))
