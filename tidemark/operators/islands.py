"""Runs, spells, eras and calendar windows over ordered records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import funding as X
from tidemark.functions.periods import seconds
from tidemark.operators.scan import blocked, carried, numbered, overlapped, same, segments, with_facts
from tidemark.session import cut

DAY = 86_400


def day_number(day: Column) -> Column:
    return F.date_diff(day.cast("date"), F.lit("1970-01-01").cast("date"))


def negative_spells(daily: DataFrame, keys: list[str], value: str, days: int = 1, least: int = 1, day: str = "day") -> DataFrame:
    """Runs of consecutive negative values ``days`` apart: (keys, first_day, last_day, length) of ``least`` or more."""
    w = Window.partitionBy(*keys).orderBy(day)
    neg = daily.where(F.col(value) < 0)
    same = neg.withColumn("_run", F.floor(day_number(F.col(day)) / days) - F.row_number().over(w))
    return same.groupBy(*keys, "_run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_run")


def longest_negative_run(daily: DataFrame, keys: list[str], value: str, day: str = "day") -> DataFrame:
    """The longest such run of each key, the first among equals, and the number of negative days."""
    runs = negative_spells(daily, keys, value, day=day)
    best = F.max_by(F.struct("first_day", "last_day", "length"), F.struct("length", (-day_number(F.col("first_day"))).alias("t")))
    return runs.groupBy(*keys).agg(best.alias("r"), F.sum("length").alias("n_negative")).select(*keys, "r.*", "n_negative")


def rolling_mean(daily: DataFrame, keys: list[str], value: str, days: int = 28, day: str = "day") -> DataFrame:
    """Mean of the last ``days`` calendar days; only windows without a missing day."""
    w = Window.partitionBy(*keys).orderBy("_d").rangeBetween(-(days - 1), 0)
    r = daily.withColumn("_d", day_number(F.col(day))).withColumns({"rolling": F.avg(value).over(w), "_n": F.count(value).over(w)})
    return r.where(F.col("_n") == days).drop("_n", "_d")


def rolling_stats(daily: DataFrame, keys: list[str], value: str, days: int = 28, day: str = "day") -> DataFrame:
    """Number of complete windows, of negative ones, the smallest mean and the day it ends (the first of equals)."""
    r = rolling_mean(daily, keys, value, days, day)
    return r.groupBy(*keys).agg(F.count("*").alias("windows"), F.count_if(F.col("rolling") < 0).alias("negative"), F.min("rolling").alias("lowest"), F.min_by(day, F.struct("rolling", day)).alias("lowest_day"))


def level_shift(daily: DataFrame, keys: list[str], value: str, last_before: str, first_after: str, days: int = 28, day: str = "day") -> DataFrame:
    """Difference of two means of ``days`` days around an event, and the share of all placements with a difference as large or larger in size.

    A placement is a day with complete windows before it and from the day ``gap`` later on, with the
    gap between the two windows that the event has.
    """
    gap = F.date_diff(F.lit(first_after).cast("date"), F.lit(last_before).cast("date"))
    r = rolling_mean(daily, keys, value, days, day).select(*keys, F.col(day).alias("end"), "rolling")
    after = r.select(*keys, F.date_sub("end", (gap + days - 1).cast("int")).alias("end"), F.col("rolling").alias("after"))
    placed = r.withColumn("end", F.col("end").cast("date")).join(after, [*keys, "end"]).withColumn("shift", F.col("after") - F.col("rolling"))
    own = F.max(F.when(F.col("end") == F.lit(last_before).cast("date"), F.col("shift"))).over(Window.partitionBy(*keys))
    return placed.withColumn("_own", own).groupBy(*keys).agg(F.max("_own").alias("shift"), F.count("*").alias("placements"), F.avg((F.abs("shift") >= F.abs("_own")).cast("double")).alias("share_as_large"))


def lagged_pairs(rows: DataFrame, keys: list[str], value: str, lag: int = 1, day: str = "day") -> DataFrame:
    """(keys, day, x, y): pairs exactly ``lag`` calendar days apart, by an equi-join on the shifted day."""
    left = rows.select(*keys, F.col(day).cast("date").alias("day"), F.col(value).alias("x"))
    right = rows.select(*keys, F.date_sub(F.col(day).cast("date"), lag).alias("day"), F.col(value).alias("y"))
    return left.join(right, [*keys, "day"]).where("x is not null and y is not null")


def autocorrelations(rows: DataFrame, keys: list[str], value: str, lags=(1, 7, 30), day: str = "day") -> DataFrame:
    """(keys, lag, acf): sum of products of deviations from the full mean over pairs, by the full sum of squares."""
    dev = with_facts(rows.where(F.col(value).isNotNull()), keys, F.avg(value).alias("_mean")).withColumn("_x", F.col(value) - F.col("_mean")).select(*keys, F.col(day).cast("date").alias("day"), "_x")
    total = dev.groupBy(*keys).agg(F.sum(F.col("_x") ** 2).alias("_ss"))
    ahead = dev.select(*keys, F.col("day").alias("_to"), F.col("_x").alias("_y"))
    spread = dev.select(*keys, "_x", F.explode(F.array(*map(F.lit, lags))).alias("lag"), "day").withColumn("_to", F.date_add("day", F.col("lag")))
    return spread.join(ahead, [*keys, "_to"]).groupBy(*keys, "lag").agg(F.sum(F.col("_x") * F.col("_y")).alias("_c")).join(total, keys).select(*keys, "lag", (F.col("_c") / F.col("_ss")).alias("acf"))


def ar1_half_life(rows: DataFrame, keys: list[str], value: str, day: str = "day") -> DataFrame:
    """Slope of the least-squares line through lagged pairs, and its half-life where 0 < slope < 1."""
    g = lagged_pairs(rows, keys, value, 1, day).groupBy(*keys).agg(F.count("*").alias("pairs"), F.regr_slope("y", "x").alias("phi"))
    return g.withColumn("half_life", F.when((F.col("phi") > 0) & (F.col("phi") < 1), F.ln(F.lit(0.5)) / F.ln("phi")))


def within_period(rows: DataFrame, keys: list[str], value: str, period: Column) -> DataFrame:
    """Adds ``within``: the value less its period's mean."""
    return rows.withColumn("_p", period).withColumn("within", F.col(value) - F.avg(value).over(Window.partitionBy(*keys, "_p"))).drop("_p")


def index_windows(rows: DataFrame, keys: list[str], order: str, width: int, step: int) -> DataFrame:
    """Each row once for every complete window of ``width`` rows that holds it; windows start every ``step`` rows."""
    at = with_facts(numbered(rows, keys, order), keys, F.count("*").alias("_n"))
    lo = F.greatest(F.ceil((F.col("_i") - width + 1) / step), F.lit(0))
    hi = F.least(F.floor(F.col("_i") / step), F.floor((F.col("_n") - width) / step))
    return at.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("window", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi", "_i", "_n")


def trailing(rows: DataFrame, keys: list[str], order: str, value: str, width: int = 24, strict: bool = True) -> DataFrame:
    """Adds ``trailing``: the mean over the last ``width`` rows; null (strict) or shorter at the start."""
    r = overlapped(rows, keys, order, behind=width - 1)
    w = Window.partitionBy(*keys, "_in").orderBy("_i").rowsBetween(-(width - 1), 0)
    mean = F.avg(value).over(w)
    r = r.withColumn("trailing", F.when(F.count(value).over(w) == width, mean) if strict else mean)
    return r.where(F.col("_in") == F.col("_block")).drop("_i", "_block", "_in")


def median_filter(rows: DataFrame, keys: list[str], order: str, value: str, width: int = 7) -> DataFrame:
    """Adds ``smooth``: the median over the row and its neighbours; beyond the ends the nearest value counts again."""
    half = width // 2
    r = with_facts(overlapped(rows, keys, order, half, half), keys, F.max("_i").alias("_last"))
    w = Window.partitionBy(*keys, "_in").orderBy("_i")
    near = F.collect_list(value).over(w.rowsBetween(-half, half))  # the row's neighbours; at the ends of the series fewer
    i = F.col("_i")
    padded = F.concat(F.array_repeat(F.get(near, F.lit(0)), F.greatest(half - i, F.lit(0)).cast("int")), near, F.array_repeat(F.element_at(near, -1), F.greatest(i + half - F.col("_last"), F.lit(0)).cast("int")))
    r = r.withColumn("smooth", F.element_at(F.array_sort(padded), half + 1)).where(F.col("_in") == F.col("_block"))
    return r.drop("_i", "_block", "_in", "_last")


def rule_records(rows: DataFrame, keys: list[str], time: str = "time", rate: str = "rate", premium: str = "premium", places: bool = False) -> DataFrame:
    """Classify funding records: adds schedule (8h or 1h), deviation (exact) and regime.

    A record four hours or more after the one before is eight-hourly (the first one: before the
    next). The eight-hour rate is the rate times 8 / hours covered. With ``places`` the rows keep
    their places in blocks, which ``eras`` then need not number again.
    """
    r = carried(cut(blocked(rows, keys, time)), keys, time, {"_prev": F.col(time)}, {"_next": F.col(time)})
    r = r if places else r.drop("_i", "_block")
    gap = F.coalesce(seconds(F.col(time)) - seconds(F.col("_prev")), seconds(F.col("_next")) - seconds(F.col(time)))
    r = r.withColumn("schedule", F.when(gap >= 4 * 3600, "8h").otherwise("1h")).drop("_prev", "_next")
    eight = F.when(F.col("schedule") == "8h", F.col(rate)).otherwise((F.col(rate) * 8).cast(X.RATE))
    at_floor = F.col(rate) == F.when(F.col("schedule") == "8h", X.literal(X.FLOOR_8H)).otherwise(X.literal(X.FLOOR_HOURLY))
    r = r.withColumn("deviation", (eight - F.col(premium)).cast(X.RATE))
    return r.withColumn("regime", X.rule_label(F.col("deviation"), at_floor))


def eras(classified: DataFrame, keys: list[str], time: str = "time", premium: str = "premium") -> DataFrame:
    """Eras of one schedule and one revealed rule, with the records between two eras assigned to one of them.

    Records that reveal no rule go to the new schedule from its first record on, to the earlier era
    if the later one is the unclamped one's successor, and else stay with the earlier era up to the
    next revealing record, counted as undetermined unless that record is unclamped. Per era: span,
    records, floor and other records, floor records outside the band and in-band records off the floor.
    """
    reveals = F.col("regime").isin("clamp_3bp", "clamp_5bp", "unclamped")
    mark = F.when(reveals, F.concat_ws(" ", "schedule", "regime"))
    r = classified.withColumn("_mark", mark)
    r = cut(r if "_block" in classified.columns else blocked(r, keys, time))
    r = cut(carried(r, keys, time, {"_back": F.col("_mark")}, {"_ahead": F.col("_mark")}, {"_stretch": F.col("_mark").isNotNull().cast("long")}))
    # from which era each record is, by the marks around it
    back_s, back_r = F.split_part("_back", F.lit(" "), F.lit(1)), F.split_part("_back", F.lit(" "), F.lit(2))
    ahead_s, ahead_r = F.split_part("_ahead", F.lit(" "), F.lit(1)), F.split_part("_ahead", F.lit(" "), F.lit(2))
    # from the first record of the new schedule on, per stretch between two marks
    new = r.where(F.col("_mark").isNull() & (F.col("schedule") == ahead_s)).groupBy(*keys, "_stretch").agg(F.min("_i").alias("_from"))
    r = same(r, new, [*keys, "_stretch"], "left").withColumn("_new", F.when(F.col("_i") >= F.col("_from"), 1)).drop("_from")
    era = (
        F.when(F.col("_mark").isNotNull(), F.col("_mark"))
        .when(F.col("_back").isNull(), F.col("_ahead"))
        .when(F.col("_ahead").isNull() | (F.col("_back") == F.col("_ahead")), F.col("_back"))
        .when(back_s != ahead_s, F.when(F.col("_new") == 1, F.col("_ahead")).otherwise(F.col("_back")))
        .when(back_r == "unclamped", F.col("_ahead"))
        .otherwise(F.col("_back"))
    )
    r = r.withColumn("_era", era)
    undetermined = F.col("_mark").isNull() & F.col("_back").isNotNull() & F.col("_ahead").isNotNull() & (F.col("_back") != F.col("_ahead")) & (back_s == ahead_s) & (back_r != "unclamped") & (ahead_r != "unclamped")
    r = segments(r.withColumn("_open", undetermined), keys, time, F.col("_era"), "era")
    clamp = F.when(F.col("_era").endswith("clamp_3bp"), X.literal(X.CLAMP_OLD)).when(F.col("_era").endswith("clamp_5bp"), X.literal(X.CLAMP))
    inside = F.col(premium).between(X.literal(X.FLOOR_8H) - clamp, X.literal(X.FLOOR_8H) + clamp)
    floor = F.col("regime") == "floor"
    return r.withColumn("_in", inside).groupBy(*keys, "era").agg(
        F.split_part(F.min("_era"), F.lit(" "), F.lit(1)).alias("schedule"), F.split_part(F.min("_era"), F.lit(" "), F.lit(2)).alias("rule"),
        F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("n_records"), F.count_if(floor).alias("n_floor"), F.count_if(F.col("regime") == "other").alias("n_other"),
        F.count_if(floor & F.coalesce(~F.col("_in"), F.lit(True))).alias("floor_not_in_band"), F.count_if(~floor & F.col("_in")).alias("in_band_not_floor"), F.count_if("_open").alias("undetermined_after"),
    )


def switch(classified: DataFrame, keys: list[str], time: str = "time", premium: str = "premium") -> DataFrame:
    """From when the wide clamp applies, and how well the records after it keep to it.

    ``late_old`` counts records of an older rule after the switch: the switch holds only if it is 0.
    """
    first = classified.groupBy(*keys).agg(F.min(F.when(F.col("regime") == "clamp_5bp", F.col(time))).alias("_switch"))
    r = classified.join(first, keys) if keys else classified.crossJoin(F.broadcast(first))  # one row
    after = F.col(time) >= F.col("_switch")
    inside = F.col(premium).between(X.literal(X.FLOOR_8H) - X.literal(X.CLAMP), X.literal(X.FLOOR_8H) + X.literal(X.CLAMP))
    common, floor = after & (F.col("schedule") == "1h"), F.col("regime") == "floor"
    n = F.count_if
    return r.groupBy(*keys).agg(F.first("_switch").alias("switch_time"), F.max(F.when(~after, F.col(time))).alias("last_before"), n(F.col("schedule") == "8h").alias("eight_hourly"), n(after & F.col("regime").isin("clamp_3bp", "unclamped")).alias("late_old"), n(common).alias("common_hours"), n(common & floor).alias("common_floor"), n(common & floor & ~inside).alias("common_floor_not_in_band"), n(common & ~floor & inside).alias("common_in_band_not_floor"), n(common & ~floor & (F.col("regime") != "clamp_5bp")).alias("common_other"))


def last_run_start(ranks: DataFrame, keys: list[str], period: str = "period", rank: str = "rank", value: str = "above_all") -> DataFrame:
    """First period of the final unbroken run of ``value``; null where the last period breaks it."""
    g = ranks.groupBy(*keys).agg(F.max(F.when(F.coalesce(F.col(rank) != value, F.lit(True)), F.col(period))).alias("_broken"), F.sort_array(F.collect_set(period)).alias("_all"))
    after = F.filter("_all", lambda p: F.col("_broken").isNull() | (p > F.col("_broken")))
    return g.select(*keys, F.try_element_at(after, F.lit(1)).alias("run_start"), F.size(after).alias("run_length"))
