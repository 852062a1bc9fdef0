"""Aligning series on one grid: first or last record per stamp, panels, gaps, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.periods import floor_to, hour_of, seconds, shifted


def one_per_stamp(rows: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row per key in the given order of columns; a deterministic dropDuplicates."""
    names = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = rows.groupBy(*keys).agg(pick(F.struct(*names), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{n}").alias(n) for n in names))


def align_hourly(rows: DataFrame, keys: list[str], time: str = "time", tie: str | None = None) -> DataFrame:
    """The earliest record of every hour, stamped with the hour."""
    order = [F.col("_at"), *([F.col(tie)] if tie else [])]
    return one_per_stamp(rows.withColumn("_at", F.col(time)).withColumn(time, hour_of(F.col(time))), [*keys, time], order).drop("_at")


def late_records(rows: DataFrame, keys: list[str], least_seconds: int = 1800, time: str = "time") -> DataFrame:
    """Records that come so long after their hour that flooring their stamp would be wrong."""
    return rows.where(F.pmod(seconds(F.col(time)), F.lit(3600)) >= least_seconds)


def duplicates_per_hour(rows: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """How many records each key has beyond one an hour."""
    return rows.groupBy(*keys, hour_of(F.col(time)).alias("hour")).count().groupBy(*keys).agg(F.sum(F.col("count") - 1).alias("n_extra"))


def log_returns(rows: DataFrame, keys: list[str], close: str, step: int = 3600, time: str = "time") -> DataFrame:
    """Adds log_return: ln of close over the close one step before; null where the step before is missing."""
    w = Window.partitionBy(*keys).orderBy(time)
    before, at = F.lag(close).over(w), F.lag(time).over(w)
    good = (seconds(F.col(time)) - seconds(at) == step) & (F.col(close) > 0) & (before > 0)
    return rows.withColumn("log_return", F.when(good, F.ln(F.col(close) / before)))


def hourly_panel(candles: DataFrame, funding: DataFrame, keys: list[str]) -> DataFrame:
    """Candles (time, close) joined with funding (time, premium_bps, funding_bps) by key and hour.

    Both sides keep their first record of an hour. The return is that of the candles' own grid, so
    a hole in the funding does not stretch it and a hole in the candles makes it null; rows with a
    null return are dropped. Nothing is filled forward.
    """
    c = log_returns(align_hourly(candles, keys), keys, "close")
    return c.join(align_hourly(funding, keys), [*keys, "time"]).where("log_return is not null")


def dropped_rows(candles: DataFrame, funding: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: hours of either side without a partner, and hours without a return."""
    c, f = log_returns(align_hourly(candles, keys), keys, "close"), align_hourly(funding, keys).select(*keys, "time", F.lit(1).alias("_f"))
    both = c.select(*keys, "time", "log_return", F.lit(1).alias("_c")).join(f, [*keys, "time"], "full")
    return both.groupBy(*keys).agg(F.count_if(F.col("_f").isNull()).alias("candles_only"), F.count_if(F.col("_c").isNull()).alias("funding_only"), F.count_if(F.col("_c").isNotNull() & F.col("_f").isNotNull() & F.col("log_return").isNull()).alias("no_return"))


def missing_steps(rows: DataFrame, keys: list[str], step: int = 3600, time: str = "time") -> DataFrame:
    """Stamps of the grid between each key's first and last record that have no record.

    The holes are read off consecutive records, so no full grid is made and joined.
    """
    at = rows.select(*keys, floor_to(F.col(time), step).alias(time)).distinct()
    nxt = F.lead(time).over(Window.partitionBy(*keys).orderBy(time))
    holes = at.select(*keys, shifted(F.col(time), step).alias("_a"), shifted(nxt, -step).alias("_b")).where("_a <= _b")
    return holes.select(*keys, F.explode(F.sequence("_a", "_b", F.make_dt_interval(secs=F.lit(step)))).alias(time))


def spacings(rows: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """The different gaps between consecutive stamps of each key, in whole hours, ascending."""
    gap = (seconds(F.col(time)) - seconds(F.lag(time).over(Window.partitionBy(*keys).orderBy(time)))) / 3600
    return rows.withColumn("_gap", gap).where("_gap is not null and _gap = floor(_gap)").groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("_gap").cast("long"))).alias("gap_hours"))


def compare_on_overlap(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], time: str = "time") -> DataFrame:
    """Per field: matched rows, largest absolute difference, where it is, and the share of equal values."""
    r = right.select(*keys, time, *(F.col(f).alias(f"_{f}") for f in fields))
    rows = left.join(r, [*keys, time])
    long = rows.select(time, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.abs(F.col(f) - F.col(f"_{f}")).alias("diff")) for f in fields))).alias("d")).select(time, "d.*")
    return long.groupBy("field").agg(F.count("*").alias("n"), F.max("diff").alias("largest"), F.max_by(time, F.struct(F.col("diff"), (-seconds(F.col(time))).alias("t"))).alias("at"), F.avg((F.col("diff") == 0).cast("double")).alias("share_equal"))


def accepted(new: DataFrame, archived: DataFrame, keys: list[str], limits: dict[str, float], least_overlap: float, time: str = "time") -> DataFrame:
    """(field, matched, largest, overlap, accepted): whether a new panel may stand for an archived one.

    ``limits``: the largest difference allowed per field; ``least_overlap``: the share of the archived
    rows that the new panel has to hold. An archive without a match is not accepted.
    """
    found = compare_on_overlap(new, archived, keys, list(limits), time).select("field", F.col("n").alias("matched"), "largest")
    spark = new.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(limits.items()), "field string, _limit double"))  # a row per field
    rows = archived.agg(F.count("*").alias("_rows"))
    out = wanted.join(found, "field", "left").crossJoin(F.broadcast(rows))  # one row
    overlap = F.coalesce("matched", F.lit(0)) / F.greatest(F.col("_rows"), F.lit(1))
    return out.select("field", F.coalesce("matched", F.lit(0)).alias("matched"), "largest", overlap.alias("overlap"), F.coalesce((overlap >= least_overlap) & (F.col("largest") <= F.col("_limit")), F.lit(False)).alias("accepted"))


def interleave_blocks(rows: DataFrame, keys: list[str], value: str, hours: int = 8, time: str = "time") -> DataFrame:
    """One row per right-closed block with the values of its hours as columns h1 .. h<hours>; null where an hour is missing."""
    from tidemark.functions.periods import block_end

    end = block_end(F.col(time), hours)
    place = hours - ((seconds(end) - seconds(F.col(time))) / 3600).cast("int")
    return rows.withColumns({"block": end, "_h": place}).groupBy(*keys, "block").agg(*(F.max(F.when(F.col("_h") == h, F.col(value))).alias(f"h{h}") for h in range(1, hours + 1)))


def reconstruct_hourly(coarse: DataFrame, proxy: DataFrame, keys: list[str], per: int = 2) -> DataFrame:
    """Hourly closes inside coarse bars, shaped by a proxy's hourly returns.

    coarse: keys, time (start of the bar), open, close; proxy: keys, time (start of the hour),
    log_return. The proxy's returns of a bar are shifted by an equal amount so that they lead from
    the bar's open to its close, where the last hour ends exactly. Bars without all hours are
    dropped.
    """
    step = 3600 * per
    p = proxy.withColumn("bar", floor_to(F.col("time"), step))
    rows = p.join(coarse.select(*keys, F.col("time").alias("bar"), "open", F.col("close").alias("bar_close")), [*keys, "bar"])
    w = Window.partitionBy(*keys, "bar")
    rows = rows.withColumns({"_n": F.count("log_return").over(w), "_sum": F.sum("log_return").over(w)}).where(F.col("_n") == per)
    run = w.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    shift = (F.ln(F.col("bar_close") / F.col("open")) - F.col("_sum")) / per
    close = F.col("open") * F.exp(F.sum(F.col("log_return") + shift).over(run))
    last = F.row_number().over(w.orderBy("time")) == per
    return rows.select(*keys, "bar", "time", F.when(last, F.col("bar_close")).otherwise(close).alias("close"), (~last).alias("estimated"))


def first_best(rows: DataFrame, keys: list[str], score: str, index: str) -> DataFrame:
    """The row with the largest score per key; the smallest index among equals."""
    return one_per_stamp(rows, keys, [-F.col(score), F.col(index)])


def changed_leaves(old: DataFrame, new: DataFrame, at: str = "path", value: str = "value") -> DataFrame:
    """(path, kind, old, new) of the leaves of two flattened documents that were changed, removed or added."""
    o, n = old.select(at, F.col(value).alias("old"), F.lit(1).alias("_o")), new.select(at, F.col(value).alias("new"), F.lit(1).alias("_n"))
    kind = F.when(F.col("_n").isNull(), "removed").when(F.col("_o").isNull(), "added").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return o.join(n, at, "full").select(at, kind.alias("kind"), "old", "new").where("kind is not null")


def expectations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that break each expectation."""
    return rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
