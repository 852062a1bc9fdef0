"""Queries on bars, panels and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import periods as P
from tidemark.operators import panel as J, resample as S
from tidemark.plans.tables import HOURLY_SQL, RECORDS_SQL as REC, hourly, records, rounded, ticks

BARS_SQL = f"""{REC}, bars AS (SELECT venue, time AS bar, 100 + arg_min(value, ts) AS open, 100 + max(value) AS high, 100 + min(value) AS low, 100 + arg_max(value, ts) AS close, sum(value) AS volume, count(*) AS n FROM fund GROUP BY 1, 2)"""
STEP = "epoch(time) - lag(epoch(time)) OVER (PARTITION BY venue ORDER BY time)"


def bars(spark, d):
    return S.ticks_to_bars(ticks(spark, d), ["venue"])


def tick_bars(spark, d):
    return rounded(bars(spark, d), "open", "high", "low", "close", "volume", digits=4)


def two_hour_bars(spark, d):
    return rounded(S.coarser_bars(bars(spark, d), ["venue"], 3600, 7200), "open", "high", "low", "close", "volume", digits=4)


def candles(spark, d):
    return bars(spark, d).select("venue", F.col("bar").alias("time"), "open", "close")


def log_returns(spark, d):
    return rounded(J.log_returns(candles(spark, d), ["venue"], "close").select("venue", "time", "log_return"), "log_return", digits=9)


def funding(spark, d):
    return records(spark, d).select("venue", F.col("ts").alias("time"), "premium_bps", (F.col("r") / 1000.0).alias("funding_bps"))


def hourly_panel(spark, d):
    """Prices of the venue's even events against funding of its odd ones, so that both sides have holes."""
    even = records(spark, d).where("event_id % 2 = 0").select("venue", F.col("ts").alias("time"), (100 + F.col("value")).alias("close"))
    odd = records(spark, d).where("event_id % 2 = 1").select("venue", F.col("ts").alias("time"), "premium_bps", (F.col("r") / 1000.0).alias("funding_bps"))
    return rounded(J.hourly_panel(even, odd, ["venue"]), "close", "log_return", "premium_bps", "funding_bps")


def panel_drops(spark, d):
    even = records(spark, d).where("event_id % 2 = 0").select("venue", F.col("ts").alias("time"), (100 + F.col("value")).alias("close"))
    return J.dropped_rows(even, records(spark, d).where("event_id % 2 = 1").select("venue", F.col("ts").alias("time")), ["venue"])


PANEL_SQL = f"""WITH {REC}, c0 AS (SELECT venue, time, 100 + arg_min(value, ts) AS close FROM fund WHERE event_id % 2 = 0 GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN {STEP} = 3600 THEN ln(close / lag(close) OVER (PARTITION BY venue ORDER BY time)) END AS log_return FROM c0),
f AS (SELECT venue, time, arg_min(premium_bps, ts) AS premium_bps, arg_min(r, ts) / 1000.0 AS funding_bps FROM fund WHERE event_id % 2 = 1 GROUP BY 1, 2)"""


def missing_hours(spark, d):
    return J.missing_steps(records(spark, d).select("venue", F.col("ts").alias("time")), ["venue"])


def hour_gaps(spark, d):
    return J.spacings(records(spark, d).select("venue", "time").distinct(), ["venue"]).select("venue", F.concat_ws(",", F.transform("gap_hours", lambda g: g.cast("string"))).alias("gap_hours"))


def late_and_extra(spark, d):
    r = records(spark, d).select("venue", F.col("ts").alias("time"))
    late = J.late_records(r, ["venue"]).groupBy("venue").agg(F.count("*").alias("n_late"))
    return late.join(J.duplicates_per_hour(r, ["venue"]), "venue", "full")


def compare_venues(spark, d):
    b = bars(spark, d).withColumnRenamed("bar", "time")
    fields = ["open", "high", "low", "close", "volume"]
    one = lambda v: b.where(F.col("venue") == v).select("time", *(F.round(f, 4).alias(f) for f in fields))
    return rounded(J.compare_on_overlap(one("click"), one("view"), [], fields), "largest", "share_equal", digits=4)


def minutes(spark, d):
    at = P.floor_to(F.col("ts"), 60)
    return records(spark, d).groupBy("venue", at.alias("time")).agg(F.avg("p").alias("p"))


def minute_hours(spark, d):
    return rounded(S.hourly_from_minutes(minutes(spark, d), ["venue"], "p"), "mean", "lwmean", "close", digits=4)


MINUTES_SQL = f"""WITH {REC}, mi AS (SELECT venue, time_bucket(INTERVAL 1 MINUTE, ts) AS m, avg(p) AS p FROM fund GROUP BY 1, 2),
h AS (SELECT venue, date_trunc('hour', m) + INTERVAL 1 HOUR AS hour, count(*) AS n, avg(p) AS mean, sum(p * (minute(m) + 1)) / sum(minute(m) + 1) AS lwmean, max(p) FILTER (minute(m) = 59) AS close FROM mi GROUP BY 1, 2),
grid AS (SELECT venue, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY 1),
mh AS (SELECT grid.venue, grid.hour, coalesce(n, 0) AS n, mean, lwmean, close FROM grid LEFT JOIN h USING (venue, hour))"""


def linear_blocks(spark, d):
    """Eight-hour means with linear and with plain weights (the kind depends on the venue)."""
    h = S.hourly_from_minutes(minutes(spark, d), ["venue"], "p").withColumn("kind", F.col("venue").isin("click", "view"))
    lin = S.linear_eight_hours(h.where("kind"), ["venue"], True, whole=False)
    return rounded(lin.unionByName(S.linear_eight_hours(h.where("not kind"), ["venue"], False, whole=False)), "value", digits=4)


def weighted_blocks(spark, d):
    h = hourly(spark, d).select("venue", P.shifted(F.col("time"), 3600).alias("hour"), F.col("m").cast("double").alias("m"))
    return rounded(S.weighted_eight_hours(h, ["venue"], "m"), "value", digits=4)


def block_means(spark, d):
    """Both closures: readings as hour ends and as hour starts."""
    h = hourly(spark, d)
    right = S.block_means(h, ["venue"], "m", True, True).withColumn("closed", F.lit("right"))
    return rounded(right.unionByName(S.block_means(h, ["venue"], "m", False, False).withColumn("closed", F.lit("left"))), "mean", digits=4)


def block_matrix(spark, d):
    return J.interleave_blocks(hourly(spark, d), ["venue"], "m")


def rebuilt_hours(spark, d):
    """Hours inside two-hour bars of one venue, shaped by another's returns."""
    two = S.coarser_bars(bars(spark, d).where("venue = 'click'"), ["venue"], 3600, 7200).select(F.col("bar").alias("time"), "open", "close")
    proxy = J.log_returns(candles(spark, d).where("venue = 'view'"), ["venue"], "close").select("time", "log_return")
    return rounded(J.reconstruct_hourly(two, proxy, []), "close")


BLOCK = "CAST(to_timestamp(CAST(ceil(epoch({t}) / 28800.0) * 28800 AS BIGINT)) AT TIME ZONE 'UTC' AS TIMESTAMP)"
H = "(7 - CAST((epoch(block) - epoch(hour)) / 3600 AS BIGINT))"

QUERIES = {
    "tick_bars": (tick_bars, f"WITH {BARS_SQL} SELECT venue, bar, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume, n FROM bars"),
    "two_hour_bars": (two_hour_bars, f"""WITH {BARS_SQL}, t AS (SELECT venue, time_bucket(INTERVAL 2 HOUR, bar, TIMESTAMP '1970-01-01') AS b, arg_min(open, bar) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar) AS close, sum(volume) AS volume, count(*) AS c FROM bars GROUP BY 1, 2)
SELECT venue, b AS bar, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume FROM t WHERE c = 2"""),
    "log_returns": (log_returns, f"WITH {BARS_SQL}, c AS (SELECT venue, bar AS time, close FROM bars) SELECT venue, time, CASE WHEN {STEP} = 3600 THEN round(ln(close / lag(close) OVER (PARTITION BY venue ORDER BY time)), 9) + 0 END AS log_return FROM c"),
    "hourly_panel": (hourly_panel, f"{PANEL_SQL} SELECT venue, time, round(close, 6) AS close, round(log_return, 6) + 0 AS log_return, round(premium_bps, 6) AS premium_bps, round(funding_bps, 6) AS funding_bps FROM c JOIN f USING (venue, time) WHERE log_return IS NOT NULL"),
    "panel_drops": (panel_drops, f"{PANEL_SQL} SELECT venue, count(*) FILTER (f.time IS NULL) AS candles_only, count(*) FILTER (c.time IS NULL) AS funding_only, count(*) FILTER (c.time IS NOT NULL AND f.time IS NOT NULL AND log_return IS NULL) AS no_return FROM c FULL JOIN f USING (venue, time) GROUP BY 1"),
    "missing_hours": (missing_hours, f"WITH {REC}, g AS (SELECT venue, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM fund GROUP BY 1) SELECT venue, time FROM g ANTI JOIN fund USING (venue, time)"),
    "hour_gaps": (hour_gaps, f"WITH {REC}, t AS (SELECT DISTINCT venue, time FROM fund), g AS (SELECT venue, CAST(({STEP}) / 3600 AS BIGINT) AS g FROM t) SELECT venue, string_agg(CAST(g AS VARCHAR), ',' ORDER BY g) AS gap_hours FROM (SELECT DISTINCT venue, g FROM g WHERE g IS NOT NULL) GROUP BY 1"),
    "late_and_extra": (late_and_extra, f"WITH {REC} SELECT venue, count(*) FILTER (epoch(ts) - epoch(time) >= 1800) AS n_late, count(*) - count(DISTINCT time) AS n_extra FROM fund GROUP BY 1"),
    "compare_venues": (compare_venues, f"""WITH {BARS_SQL}, j AS (SELECT a.bar AS t, unnest(['open', 'high', 'low', 'close', 'volume']) AS field, unnest([abs(round(a.open, 4) - round(b.open, 4)), abs(round(a.high, 4) - round(b.high, 4)), abs(round(a.low, 4) - round(b.low, 4)), abs(round(a.close, 4) - round(b.close, 4)), abs(round(a.volume, 4) - round(b.volume, 4))]) AS diff FROM bars a JOIN bars b ON a.bar = b.bar AND a.venue = 'click' AND b.venue = 'view')
SELECT field, count(*) AS n, round(max(diff), 4) AS largest, arg_max(t, {{'d': diff, 't': -epoch(t)}}) AS "at", round(avg(CASE WHEN diff = 0 THEN 1.0 ELSE 0.0 END), 4) AS share_equal FROM j GROUP BY 1"""),
    "minute_hours": (minute_hours, f"{MINUTES_SQL} SELECT venue, hour, n, round(mean, 4) AS mean, round(lwmean, 4) AS lwmean, round(close, 4) AS close FROM mh"),
    "linear_blocks": (linear_blocks, f"""{MINUTES_SQL}, b AS (SELECT *, {BLOCK.format(t="hour")} AS block FROM mh)
SELECT venue, block, count(*) FILTER (n >= 60) = 8 AS complete, count(*) FILTER (n > 0) AS hours, round(CASE WHEN venue IN ('click', 'view') THEN sum(3600 * {H} * mean + 1830 * lwmean) / 115440 ELSE avg(mean) END, 4) AS value FROM b GROUP BY 1, 2"""),
    "weighted_blocks": (weighted_blocks, f"""WITH {REC}, {HOURLY_SQL}, b AS (SELECT venue, m, time + INTERVAL 1 HOUR AS hour, {BLOCK.format(t="(time + INTERVAL 1 HOUR)")} AS block FROM hr)
SELECT venue, block, round(sum((3600 * {H} + 1830) * m) / sum(3600 * {H} + 1830), 4) AS value, count(*) AS hours FROM b GROUP BY 1, 2"""),
    "block_means": (block_means, f"""WITH {REC}, {HOURLY_SQL}, r AS (SELECT venue, {BLOCK.format(t="time")} AS block, avg(m) AS mean, count(*) AS n FROM hr GROUP BY 1, 2), l AS (SELECT venue, time_bucket(INTERVAL 8 HOUR, time, TIMESTAMP '1970-01-01') + INTERVAL 8 HOUR AS block, avg(m) AS mean, count(*) AS n FROM hr GROUP BY 1, 2)
SELECT venue, block, round(mean, 4) AS mean, n, 'right' AS closed FROM r WHERE n = 8 UNION ALL SELECT venue, block, round(mean, 4), n, 'left' FROM l"""),
    "block_matrix": (block_matrix, f"WITH {REC}, {HOURLY_SQL}, b AS (SELECT venue, m, {BLOCK.format(t='time')} AS block, time FROM hr) SELECT venue, block, " + ", ".join(f"max(m) FILTER (epoch(block) - epoch(time) = {3600 * (8 - h)}) AS h{h}" for h in range(1, 9)) + " FROM b GROUP BY 1, 2"),
    "rebuilt_hours": (rebuilt_hours, f"""WITH {BARS_SQL}, t AS (SELECT time_bucket(INTERVAL 2 HOUR, bar, TIMESTAMP '1970-01-01') AS b, arg_min(open, bar) AS open, arg_max(close, bar) AS bc, count(*) AS c FROM bars WHERE venue = 'click' GROUP BY 1),
c AS (SELECT venue, bar AS time, close FROM bars WHERE venue = 'view'), p AS (SELECT time, CASE WHEN {STEP} = 3600 THEN ln(close / lag(close) OVER (ORDER BY time)) END AS lr FROM c),
j AS (SELECT b, time, open, bc, lr, count(lr) OVER (PARTITION BY b) AS n, sum(lr) OVER (PARTITION BY b) AS s, row_number() OVER (PARTITION BY b ORDER BY time) AS i FROM p JOIN t ON time_bucket(INTERVAL 2 HOUR, p.time, TIMESTAMP '1970-01-01') = b AND t.c = 2)
SELECT b AS bar, time, round(CASE WHEN i = 2 THEN bc ELSE open * exp(lr + (ln(bc / open) - s) / 2) END, 6) AS close, i < 2 AS estimated FROM j WHERE n = 2"""),
}
