"""How the tables of a folder stand in for funding series.

An event is a record of the venue ``event_type``: its value in cents, less 50.00, is the premium in
milli-bps (whole numbers, so that both engines compute exactly), and the funding rate follows from
the clamp. ``100 + value`` is a trade's price, ``value`` its amount. Orders give daily series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import funding as X
from tidemark.functions.periods import hour_of

RECORDS_SQL = """
rec AS (SELECT event_id, event_type AS venue, ts, value, CAST(round(value * 100) AS BIGINT) - 5000 AS p, date_trunc('hour', ts) AS time FROM events),
fund AS (SELECT *, p + greatest(least(1000 - p, 5000), -5000) AS r, p / 1000.0::DOUBLE AS premium_bps FROM rec)"""
DAILY_SQL = "daily AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) - 270000 AS v FROM orders GROUP BY 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, venue, ts, value, p, time, r (milli-bps), premium_bps, and the exact rate and premium."""
    p = F.round(F.col("value") * 100).cast("long") - 5000
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("venue"), "ts", "value", p.alias("p"), hour_of(F.col("ts")).alias("time"))
    r = F.col("p") + F.greatest(F.least(1000 - F.col("p"), F.lit(5000)), F.lit(-5000))
    exact = lambda c: (F.col(c).cast("decimal(12,0)") * F.lit("0.0000001").cast("decimal(8,7)")).cast(X.RATE)
    return e.withColumns({"r": r, "premium_bps": F.col("p") / 1000.0}).withColumns({"rate": exact("r"), "premium": exact("p")})


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("venue", F.col("ts").alias("time"), F.col("event_id").alias("id"), (100 + F.col("value")).alias("price"), F.col("value").alias("amount"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: k, day, v (mean order price less 270,000), with days missing at small scales."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg((F.avg("o_totalprice") - 270000).alias("v")).withColumn("k", F.lit("orders"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue, time (hour), m: mean premium in milli-bps of the hour's records, rounded to a whole number."""
    return records(spark, sf_dir).groupBy("venue", "time").agg(F.round(F.avg("p")).cast("long").alias("m"))


HOURLY_SQL = "hr AS (SELECT venue, time, CAST(round(avg(p)) AS BIGINT) AS m FROM fund GROUP BY venue, time)"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """The named columns rounded, without negative zeros; halves are told in units of the last digit, as SQL does, not by the number's shortest text."""
    unit = F.lit(float(10**digits))
    return df.withColumns({n: F.round(F.col(n).cast("double") * unit) / unit + F.lit(0.0) for n in names})


def texts(df: DataFrame, *names: str) -> DataFrame:
    """The named columns as text."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})
