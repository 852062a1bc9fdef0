"""From finer to coarser time: ticks to bars, minutes to hours, hours to eight-hour blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.periods import block_end, floor_to, hour_of, next_block, seconds, shifted

MINUTES = 60
LINEAR_TOTAL = 115_440  # 1 + 2 + ... + 480


def ticks_to_bars(ticks: DataFrame, keys: list[str], step: int = 3600, time: str = "time", tie: str = "id") -> DataFrame:
    """OHLCV bars of trades (price, amount); open and close by time, then by ``tie``."""
    order = F.struct(time, tie)
    return ticks.groupBy(*keys, floor_to(F.col(time), step).alias("bar")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("amount").alias("volume"), F.count("*").alias("n"))


def coarser_bars(bars: DataFrame, keys: list[str], src: int, dst: int) -> DataFrame:
    """Bars of ``dst`` seconds from bars of ``src`` seconds, on the grid from 1970; only complete ones."""
    g = bars.groupBy(*keys, floor_to(F.col("bar"), dst).alias("to")).agg(F.min_by("open", "bar").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("parts"))
    return g.where(F.col("parts") == dst // src).drop("parts").withColumnRenamed("to", "bar")


def hourly_from_minutes(minutes: DataFrame, keys: list[str], value: str, time: str = "time") -> DataFrame:
    """Minutes (stamped when they open) to hours (stamped when they end): n, mean, position-weighted mean, close.

    The weight of a minute is its place 1..60 in the hour; close is the 60th minute's value, null
    where that is missing. Hours without a minute between a key's first and last hour are kept with n = 0.
    """
    place = (F.pmod(F.floor(seconds(F.col(time)) / 60), F.lit(60)) + 1).cast("int")
    end = shifted(hour_of(F.col(time)), 3600)
    hours = minutes.groupBy(*keys, end.alias("hour")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.sum(F.col(value) * place) / F.sum(F.when(F.col(value).isNotNull(), place))).alias("lwmean"), F.max(F.when(place == 60, F.col(value))).alias("close"))
    grid = hours.groupBy(*keys).agg(F.explode(F.sequence(F.min("hour"), F.max("hour"), F.expr("interval 1 hour"))).alias("hour"))
    return grid.join(hours, [*keys, "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def linear_eight_hours(hours: DataFrame, keys: list[str], linear: Column | bool = True, whole: bool = True, time: str = "hour") -> DataFrame:
    """Eight-hour means of hourly (n, mean, lwmean), stamped at the block's end.

    Linear: the weights 1..480 of the block's minutes, put together from each hour's mean and
    position-weighted mean: sum(60 * 60 * h * mean + 1830 * lwmean) / 115440 for h = 0..7. Else the
    plain mean. With ``whole``, null unless all eight hours have all minutes.
    """
    end = block_end(F.col(time))
    h = 7 - (seconds(end) - seconds(F.col(time))) / 3600
    weighted = F.sum(3600 * h * F.col("mean") + 1830 * F.col("lwmean")) / LINEAR_TOTAL
    plain, full = F.avg("mean"), (F.count_if(F.col("n") >= MINUTES) == 8)
    kind = F.lit(linear) if isinstance(linear, bool) else linear
    value = F.when(kind, weighted).otherwise(plain)
    rows = hours.groupBy(*keys, end.alias("block")).agg(full.alias("complete"), F.count_if(F.col("n") > 0).alias("hours"), weighted.alias("_w"), plain.alias("_p"))
    value = F.when(kind, F.col("_w")).otherwise(F.col("_p"))
    return rows.withColumn("value", F.when(F.col("complete"), value) if whole else value).drop("_w", "_p")


def weighted_eight_hours(hours: DataFrame, keys: list[str], value: str, linear: bool = True, time: str = "hour") -> DataFrame:
    """Eight-hour weighted mean of the hours that are there (weights of the missing ones are shared out), and their number."""
    end = block_end(F.col(time))
    place = 8 - (seconds(end) - seconds(F.col(time))) / 3600
    w = F.when(F.col(value).isNotNull(), 3600 * (place - 1) + 1830 if linear else F.lit(1.0))
    return hours.groupBy(*keys, end.alias("block")).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("value"), F.count(value).alias("hours"))


def block_means(rows: DataFrame, keys: list[str], value: str, right_closed: bool, whole: bool, hours: int = 8, time: str = "time") -> DataFrame:
    """Mean per eight-hour block, stamped at its end.

    ``right_closed``: readings stamped when the hour ends, blocks (t - 8 h, t]; else readings stamped
    when the hour opens, blocks [t - 8 h, t). With ``whole`` only blocks of all eight readings.
    """
    end = block_end(F.col(time), hours) if right_closed else next_block(F.col(time), hours)
    g = rows.groupBy(*keys, end.alias("block")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return g.where(F.col("n") == hours) if whole else g
