"""Hours, eight-hour blocks, calendar periods and named spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPAN = "name string, lo timestamp_ntz, hi timestamp_ntz, left_closed boolean"
# fixed values
INTERVAL_SECONDS = {"1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "8h": 28800, "12h": 43200, "1d": 86400}
KEPT_BARS = 5000


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def seconds(time: Column) -> Column:
    """Seconds since 1970 of a zone-less UTC stamp."""
    return F.unix_seconds(time.cast("timestamp"))


def from_seconds(s: Column) -> Column:
    return ntz(F.timestamp_seconds(s))


def floor_to(time: Column, step: int) -> Column:
    """Start of the step of ``step`` seconds that holds ``time``, on the grid from 1970."""
    return from_seconds(F.floor(seconds(time) / step) * step)


def hour_of(time: Column) -> Column:
    return floor_to(time, 3600)


def block_end(time: Column, hours: int = 8) -> Column:
    """End of the right-closed block (t - hours, t] that holds ``time``, to the microsecond: a fraction of a second past an end belongs to the next block."""
    m = F.unix_micros(time.cast("timestamp"))
    return ntz(F.timestamp_micros(m + F.pmod(-m, F.lit(3_600_000_000 * hours))))


def next_block(time: Column, hours: int = 8) -> Column:
    """End of the left-closed block [t - hours, t) that holds ``time``."""
    return from_seconds((F.floor(seconds(time) / (3600 * hours)) + 1) * 3600 * hours)


def shifted(time: Column, by: int) -> Column:
    return ntz(time + F.make_dt_interval(secs=F.lit(by)))


def period(time: Column, freq: str, back: int = 1) -> Column:
    """Key of the year, half-year, quarter, month or day of the stamp ``back`` seconds earlier.

    A stamp at a period's first instant closes the period before.
    """
    t = shifted(time, -back)
    year, month = F.year(t).cast("string"), F.month(t)
    return {
        "Y": year,
        "H": F.concat(year, F.when(month <= 6, "H1").otherwise("H2")),
        "Q": F.concat(year, F.lit("Q"), F.quarter(t).cast("string")),
        "M": F.date_format(t, "yyyy-MM"),
        "D": F.date_format(t, "yyyy-MM-dd"),
    }[freq]


def period_bounds(time: Column, freq: str) -> tuple[Column, Column]:
    """Start and end of the period that holds the instant just before ``time``."""
    t = shifted(time, -1)
    months = {"Y": 12, "H": 6, "Q": 3, "M": 1}[freq]
    first = (F.year(t) * 12 + F.month(t) - 1) / months
    month0 = (F.floor(first) * months).cast("int")
    at = lambda m: ntz(F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1)))
    return at(month0), at(month0 + months)


def span_label(lo: Column, hi: Column) -> Column:
    """Text of a span; an end at midnight belongs to the day before."""
    return F.concat(F.date_format(lo, "yyyy-MM-dd"), F.lit(" to "), F.date_format(shifted(hi, -60), "yyyy-MM-dd"))


def spans(spark: SparkSession, rows: Sequence[tuple[str, str, str, bool]]) -> DataFrame:
    """A table of a few named spans (name, lo, hi, left_closed); the right end is always closed."""
    return spark.createDataFrame([(n, lo, hi, c) for n, lo, hi, c in rows], "name string, lo string, hi string, left_closed boolean").select("name", F.col("lo").cast("timestamp_ntz").alias("lo"), F.col("hi").cast("timestamp_ntz").alias("hi"), "left_closed")


def in_spans(rows: DataFrame, named: DataFrame, time: str = "time") -> DataFrame:
    """Each row once for every span that holds it, with the span's name. The span table has a few rows (checked)."""
    if named.limit(1001).count() > 1000:
        raise ValueError("over 1,000 spans: join by period keys instead")
    t = F.col(time)
    holds = (t <= F.col("hi")) & ((t > F.col("lo")) | (F.col("left_closed") & (t == F.col("lo"))))
    return rows.join(F.broadcast(named), holds).drop("lo", "hi", "left_closed").withColumnRenamed("name", "span")


def interval_seconds(name: Column) -> Column:
    """Seconds of a bar interval by name, null for an unknown one."""
    pairs = [x for k, v in INTERVAL_SECONDS.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), name)


def reach(interval: Column, now: Column) -> Column:
    """Earliest bar that an interval's retention of bars still holds."""
    return from_seconds(seconds(now) - interval_seconds(interval) * KEPT_BARS)


def expiry(interval: Column, target: Column) -> Column:
    """When the bar at ``target`` falls out of an interval's retention."""
    return from_seconds(seconds(target) + interval_seconds(interval) * KEPT_BARS)


def parse_stamp(text: Column) -> Column:
    """UTC stamp of epoch seconds, epoch milliseconds or ISO-8601 text; null for anything else."""
    number = F.when(F.trim(text).rlike("^[0-9]+$"), F.trim(text).try_cast("long"))
    return F.when(number > 100_000_000_000, ntz(F.timestamp_millis(number))).when(number.isNotNull(), ntz(F.timestamp_seconds(number))).otherwise(ntz(F.try_to_timestamp(F.regexp_replace(F.trim(text), "(Z|[+]00:00)$", ""))))


def parse_day(text: Column) -> Column:
    """Date of text in one of four layouts: 2024-01-31, 20240131, 2024/01/31, 31.01.2024; null for anything else."""
    t = F.trim(text)
    return F.coalesce(*(F.try_to_timestamp(F.when(t.rlike(p), t), F.lit(f)) for p, f in ((r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{4}/\d\d/\d\d$", "yyyy/MM/dd"), (r"^\d\d\.\d\d\.\d{4}$", "dd.MM.yyyy")))).cast("date")
