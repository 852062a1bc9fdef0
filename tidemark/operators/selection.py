"""Exact quantiles, ranks and resampled medians without sorting or holding a key's values.

A sketch gives a grid of values, whose ranks are known up to its error bound; counting tells how
many rows lie below and within a range of it exactly. So the range of an order statistic shrinks by
two orders with each pass over the rows, and only what lies in the last one is put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.scan import numbered, same, with_facts
from tidemark.session import cut

GRID, ACCURACY = 256, 10_000  # a sketch's ranks are within 1/ACCURACY of all rows: far less than a step of the grid


def _grid(value: Column) -> Column:
    return F.percentile_approx(value, F.array(*(F.lit(i / GRID) for i in range(GRID + 1))), F.lit(ACCURACY))


def _around(grid: Column, low: Column, high: Column) -> Column:
    """The range between two shares of a sketch's rows, a step wider on both sides."""
    at = lambda x: F.get(grid, F.greatest(F.least(x, F.lit(GRID)), F.lit(0)).cast("int"))
    return F.struct(at(F.floor(low * GRID) - 1).alias("a"), at(F.ceil(high * GRID) + 1).alias("b"))


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: Sequence[float], rounds: int = 2) -> DataFrame:
    """(keys, n, q): the number of values that are not null and their quantiles ``probs``, between two order statistics by their distance.

    Equal to ``percentile``. Each of the ``rounds`` passes narrows the range of every quantile to
    some hundredth of its rows; the different values of the last range, with their numbers, are
    cumulated. A range that a count disproves is not taken. Keys without a value are left out.
    """
    given = cut(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")))
    facts = given.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("_min"), F.max("v").alias("_max"), _grid(F.col("v")).alias("_g"))
    n, names = F.col("n"), range(len(probs))
    place = [(n - 1) * F.lit(float(p)) for p in probs]
    low, high = [F.floor(h) for h in place], [F.ceil(h) for h in place]
    whole = F.struct(F.col("_min").alias("a"), F.col("_max").alias("b"), F.lit(0).cast("long").alias("below"))
    state = facts.select(*keys, "n", *(whole.alias(f"_r{j}") for j in names), *(_around(F.col("_g"), low[j] / n, (high[j] + 1) / n).alias(f"_t{j}") for j in names))
    for made in range(rounds + 1):
        state = cut(state)
        tried = same(given, state, keys) if keys else given.crossJoin(F.broadcast(state))  # one row
        inside = lambda j: F.col("v").between(F.col(f"_t{j}.a"), F.col(f"_t{j}.b"))
        more = [] if made == rounds else [_grid(F.when(inside(j), F.col("v"))).alias(f"_g{j}") for j in names]
        seen = tried.groupBy(*keys).agg(*(F.count_if(F.col("v") < F.col(f"_t{j}.a")).alias(f"_b{j}") for j in names), *(F.count_if(F.col("v") <= F.col(f"_t{j}.b")).alias(f"_u{j}") for j in names), *more)
        both = same(state, seen, keys) if keys else state.crossJoin(seen)  # one row each
        kept = []
        for j in names:
            ok = (F.col(f"_b{j}") <= low[j]) & (F.col(f"_u{j}") > high[j])
            new = F.struct(F.col(f"_t{j}.a").alias("a"), F.col(f"_t{j}.b").alias("b"), F.col(f"_b{j}").alias("below"))
            kept.append(F.when(ok, new).otherwise(F.col(f"_r{j}")).alias(f"_r{j}"))
            if more:
                all_ = F.col(f"_u{j}") - F.col(f"_b{j}")
                closer = _around(F.col(f"_g{j}"), (low[j] - F.col(f"_b{j}")) / all_, (high[j] + 1 - F.col(f"_b{j}")) / all_)
                kept.append(F.when(ok, closer).otherwise(F.col(f"_t{j}")).alias(f"_t{j}"))
        state = both.select(*keys, "n", *kept)
    state = cut(state)
    tried = same(given, state, keys) if keys else given.crossJoin(F.broadcast(state))
    ranges = F.array(*(F.struct(F.lit(j).alias("j"), low[j].alias("lo"), high[j].alias("hi"), place[j].alias("h"), F.col(f"_r{j}.a").alias("a"), F.col(f"_r{j}.b").alias("b"), F.col(f"_r{j}.below").alias("below")) for j in names))
    left = tried.withColumn("_j", F.explode(F.filter(ranges, lambda r: F.col("v").between(r["a"], r["b"]))))
    counts = left.groupBy(*keys, "_j", "v").agg(F.count("*").alias("_c"))
    upto = F.col("_j.below") + F.sum("_c").over(Window.partitionBy(*keys, "_j.j").orderBy("v"))
    found = counts.withColumn("_upto", upto).groupBy(*keys, "_j").agg(F.min(F.when(F.col("_upto") > F.col("_j.lo"), F.col("v"))).alias("_x"), F.min(F.when(F.col("_upto") > F.col("_j.hi"), F.col("v"))).alias("_y"))
    h, lo, hi = F.col("_j.h"), F.col("_j.lo"), F.col("_j.hi")
    q = F.when((lo == hi) | (F.col("_x") == F.col("_y")), F.col("_x")).otherwise((hi - h) * F.col("_x") + (h - lo) * F.col("_y"))
    got = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_j.j").alias("j"), q.alias("q")))), lambda s: s["q"]).alias("q"))
    return same(state.select(*keys, "n"), got, keys) if keys else state.select("n").crossJoin(got)


def _buckets(values: DataFrame, keys: list[str]) -> DataFrame:
    """Adds _bucket, in ascending order of v, some hundredth of the rows each."""
    return with_facts(values, keys, _grid(F.col("v")).alias("_g")).withColumn("_bucket", F.size(F.filter("_g", lambda e: e <= F.col("v")))).drop("_g")


def value_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, c, rank): each different value, how often it stands, and its rank with ties at their mean.

    Equal values are counted before anything is put in order, so a value that stands often is one
    row; the rest is ordered within buckets, and a bucket's first rank follows from the counts of
    the buckets before it.
    """
    counts = cut(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")))
    bucketed = cut(_buckets(counts, keys))
    heads = bucketed.groupBy(*keys, "_bucket").agg(F.sum("c").alias("_s")).withColumn("_head", F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "_bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return same(bucketed.withColumn("_before", before), heads, [*keys, "_bucket"]).select(*keys, "v", "c", (F.col("_head") + F.col("_before") + (F.col("c") + 1) / 2).alias("rank"))


def correlations(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n, Pearson's and Spearman's correlation of the rows that have both; no key is sorted, pairs that stand often are counted."""
    both = cut(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("w")))
    weighted = lambda c: both.groupBy(*keys, F.col(c).alias("v")).agg(F.sum("w").alias("c"))
    r = both
    for c in ("x", "y"):
        counts = cut(_buckets(weighted(c), keys))
        heads = counts.groupBy(*keys, "_bucket").agg(F.sum("c").alias("_s")).withColumn("_head", F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "_bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = same(counts.withColumn("_before", before), heads, [*keys, "_bucket"]).select(*keys, F.col("v").alias(c), (F.col("_head") + F.col("_before") + (F.col("c") + 1) / 2).alias(f"_r{c}"))
        r = same(r, ranks, [*keys, c])
    r = with_facts(r, keys, F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("_mx"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("_my"))
    dx, dy, middle, w = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my"), (F.col("n") + 1) / 2, F.col("w")
    rx, ry = F.col("_rx") - middle, F.col("_ry") - middle
    corr = lambda a, b: F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b)))
    return r.groupBy(*keys).agg(F.first("n").alias("n"), corr(dx, dy).alias("pearson"), corr(rx, ry).alias("spearman"))


def drawn(rep: Column, j: Column, below: Column, seed: int) -> Column:
    """A whole number from 0 to below - 1 for draw j of a replicate, the same on every engine: 32 bits of a digest."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), j.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), below)


def bootstrap_medians(rows: DataFrame, keys: list[str], value: str, order: str, block: int = 24, reps: int = 2000, seed: int = 1) -> DataFrame:
    """(keys, rep, n, median): medians of moving-block replicates, each as long as the series.

    A replicate is a number of drawn block starts, as rows. Each start's rows are counted by
    bucket of value, once for all replicates; a replicate's counts are sums of these, and its median
    lies in the bucket where they reach the middle; only that bucket's rows are then looked at by
    value. So no task holds a series, or a replicate of one.
    """
    given = numbered(rows.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("double").alias("v")), keys, order)
    given = cut(_buckets(with_facts(given, keys, F.count("*").alias("n")), keys))
    width = F.least(F.lit(block).cast("long"), F.col("n"))
    starts, draws_n = F.col("n") - width + 1, F.ceil(F.col("n") / width)
    facts = given.select(*keys, "n").groupBy(*keys).agg(F.first("n").alias("n"))
    draws = facts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), draws_n - 1)))
    last = F.col("_j") == draws_n - 1
    draws = draws.select(*keys, "rep", drawn(F.col("rep"), F.col("_j"), starts, seed).alias("_s"), last.alias("_short")).groupBy(*keys, "_s", "_short", "rep").agg(F.count("*").alias("_d"))
    draws = cut(draws)
    # the rows of each start; a replicate's last block is cut to its length
    tail = F.col("n") - (draws_n - 1) * width
    first, final = F.greatest(F.col("_i") - width + 1, F.lit(0)), F.least(F.col("_i"), F.col("n") - width)
    spread = given.withColumn("_s", F.explode(F.sequence(first, final))).withColumn("_in_tail", F.col("_i") - F.col("_s") < tail)
    spread = cut(spread.select(*keys, "n", "_s", "v", "_bucket", "_in_tail"))
    weight = lambda c: F.when(F.col("_short"), F.col(f"{c}_t")).otherwise(F.col(f"{c}_f"))
    held = spread.groupBy(*keys, "n", "_s", "_bucket").agg(F.count("*").alias("_k_f"), F.count_if("_in_tail").alias("_k_t"))
    counts = same(draws, held, [*keys, "_s"]).groupBy(*keys, "rep", "n", "_bucket").agg(F.sum(F.col("_d") * weight("_k")).alias("_c")).where("_c > 0")
    upto = F.sum("_c").over(Window.partitionBy(*keys, "rep").orderBy("_bucket"))
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r)
    middle = counts.withColumn("_upto", upto).where(holds(lo) | holds(hi)).select(*keys, "rep", "_bucket", (F.col("_upto") - F.col("_c")).alias("_below"))
    middle = cut(middle)
    near = same(same(draws, middle, [*keys, "rep"]), spread, [*keys, "_s", "_bucket"])
    values = near.groupBy(*keys, "rep", "n", "_bucket", "_below", "v").agg(F.sum(F.when(~F.col("_short") | F.col("_in_tail"), F.col("_d")).otherwise(0)).alias("_c")).where("_c > 0")
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys, "rep", "_bucket").orderBy("v"))
    placed = values.withColumn("_upto", upto)
    pick = lambda r: F.max(F.when(holds(r), F.col("v")))
    return placed.groupBy(*keys, "rep", "n").agg(((pick(lo) + pick(hi)) / 2).alias("median"))


def bootstrap_interval(rows: DataFrame, keys: list[str], value: str, order: str, block: int = 24, reps: int = 2000, level: float = 0.95, seed: int = 1) -> DataFrame:
    """(keys, n, median, lo, hi): the median and its percentile interval over ``reps`` replicates."""
    tail = (1 - level) / 2
    medians = bootstrap_medians(rows, keys, value, order, block, reps, seed)
    spread = medians.groupBy(*keys).agg(F.percentile("median", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))  # of ``reps`` numbers
    point = quantiles(rows, keys, value, (0.5,))
    return same(point, spread, keys).select(*keys, "n", F.get("q", F.lit(0)).alias("median"), F.get("_q", F.lit(0)).alias("lo"), F.get("_q", F.lit(1)).alias("hi"))
