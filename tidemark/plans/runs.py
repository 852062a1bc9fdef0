"""Queries on runs, rolling windows and autocorrelation of daily series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import periods as P
from tidemark.operators import islands as I, stats as T
from tidemark.plans.tables import DAILY_SQL as DAY, HOURLY_SQL, RECORDS_SQL as REC, daily, hourly, records, rounded, texts

ISLANDS = f"WITH {DAY}, neg AS (SELECT day, date_diff('day', DATE '1970-01-01', day) - row_number() OVER (ORDER BY day) AS run FROM daily WHERE v < 0), sp AS (SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS length FROM neg GROUP BY run)"


def spells(spark, d):
    return texts(I.negative_spells(daily(spark, d), ["k"], "v", least=2), "first_day", "last_day")


def longest_run(spark, d):
    return texts(I.longest_negative_run(daily(spark, d), ["k"], "v"), "first_day", "last_day")


def rolling(spark, d):
    return texts(rounded(I.rolling_mean(daily(spark, d), ["k"], "v", 28).select("k", "day", "rolling"), "rolling", digits=2), "day")


def rolling_stats(spark, d):
    return texts(rounded(I.rolling_stats(daily(spark, d), ["k"], "v", 28), "lowest", digits=2), "lowest_day")


def level_shift(spark, d):
    return rounded(I.level_shift(daily(spark, d), ["k"], "v", "1997-06-30", "1997-07-02", 28), "shift", "share_as_large", digits=4)


def acf(spark, d):
    return rounded(I.autocorrelations(daily(spark, d), ["k"], "v"), "acf", digits=9)


def ar1(spark, d):
    return rounded(I.ar1_half_life(daily(spark, d), ["k"], "v"), "phi", "half_life", digits=7)


def within_quarter(spark, d):
    q = F.concat(F.year("day").cast("string"), F.lit("Q"), F.quarter("day").cast("string"))
    return rounded(I.within_period(daily(spark, d), ["k"], "v", q).select("k", "day", "within"), "within", digits=3).withColumn("day", F.col("day").cast("string"))


def weekly_means(spark, d):
    """Means of weeks from Monday with five days or more."""
    w = daily(spark, d).groupBy("k", F.date_trunc("week", "day").cast("date").alias("week")).agg(F.avg("v").alias("mean"), F.count("*").alias("n")).where("n >= 5")
    return texts(rounded(w, "mean", digits=3), "week")


def index_windows(spark, d):
    h = I.index_windows(hourly(spark, d), ["venue"], "time", 168, 48)
    return rounded(h.groupBy("venue", "window").agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count("*").alias("n"), F.avg("m").alias("mean")), "mean", digits=4)


def trailing(spark, d):
    h = hourly(spark, d)
    strict = I.trailing(h, ["venue"], "time", "m").withColumnRenamed("trailing", "strict")
    return rounded(I.trailing(strict, ["venue"], "time", "m", 24, False), "strict", "trailing", digits=4)


def median_filter(spark, d):
    return I.median_filter(hourly(spark, d), ["venue"], "time", "m")


def variants(spark, d):
    h = T.sensitivity_variants(hourly(spark, d).withColumn("m", F.col("m").cast("double")), ["venue"], "m", "time")
    return rounded(h.groupBy("venue", "variant").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.max("m").alias("largest")), "mean", "largest", digits=4)


def injected(spark, d):
    h = T.injected(hourly(spark, d).withColumn("m", F.col("m").cast("double")), ["venue"], "m", "time", 99999.0, (0, 100, 300))
    return rounded(h.groupBy("venue", "position").agg(F.count("*").alias("n"), F.sum("m").alias("total"), F.max_by("time", F.struct("m")).alias("top_time")), "total", digits=3)


def trimmed(spark, d):
    h = T.trimmed(hourly(spark, d), ["venue"], "m", "time", 8)
    return h.groupBy("venue").agg(F.count("*").alias("n"), F.sum("m").alias("total"), F.max(F.abs("m")).alias("largest"))


def winsorised(spark, d):
    h = T.winsorised(records(spark, d), ["venue"], "premium_bps")
    return rounded(h.groupBy("venue").agg(F.min("capped").alias("lo"), F.max("capped").alias("hi"), F.avg("capped").alias("mean")), "lo", "hi", "mean")


def gaussian(spark, d):
    return rounded(T.gaussian_fit(records(spark, d), ["venue"], "premium_bps"), "mu", "var", "loglik", "aic", "bic", digits=4)


def jarque_bera(spark, d):
    return rounded(T.jarque_bera(records(spark, d), ["venue"], "premium_bps").select("venue", "n", "jb", "p"), "jb", "p", digits=5)


def ljung_box(spark, d):
    return rounded(T.ljung_box(hourly(spark, d), ["venue"], "m", "time"), "q", "p", digits=6)


def hac(spark, d):
    h = records(spark, d).select("venue", "event_id", "premium_bps", (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 100.0).alias("x"))
    return rounded(T.hac_slope(h, ["venue"], "premium_bps", "x", "event_id", 20), "slope", "se", "lo", "hi", digits=7)


def correlations(spark, d):
    h = hourly(spark, d)
    one = h.where("venue = 'click'").select("time", F.col("m").alias("a"))
    both = one.join(h.where("venue <> 'click'").select("venue", "time", F.col("m").alias("b")), "time")
    return rounded(T.correlations(both, ["venue"], "a", "b"), "pearson", "spearman", digits=8)


def arch(spark, d):
    return rounded(T.arch_lm(hourly(spark, d), ["venue"], "m", "time"), "lm", "f", digits=4)


def bootstrap_median(spark, d):
    return T.block_bootstrap_median(hourly(spark, d).withColumn("m", F.col("m").cast("double")), ["venue"], "m", "time", 24, 2000)


LJ = ", ".join(f"sum(d * lag{k}) / sum(d * d) AS r{k}" for k in range(1, 25))
LJQ = lambda m: "n * (n + 2) * (" + " + ".join(f"r{k} ** 2 / (n - {k})" for k in range(1, m + 1)) + ")"
CHI = lambda q, m: f"exp(-({q}) / 2) * (" + " + ".join(f"(({q}) / 2) ** {i} / {math.factorial(i)}" for i in range(m // 2)) + ")"
LAGS = ", ".join(f"lag(d, {k}) OVER (PARTITION BY venue ORDER BY time) AS lag{k}" for k in range(1, 25))
AHEAD = " + ".join(f"2 * (1 - {k} / 21.0) * coalesce(lead(s, {k}) OVER w, 0)" for k in range(1, 21))
V = "h AS (SELECT venue, time, CAST(m AS DOUBLE) AS m FROM hr)"

QUERIES = {
    "negative_spells": (spells, f"{ISLANDS} SELECT 'orders' AS k, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, length FROM sp WHERE length >= 2"),
    "longest_negative_run": (longest_run, f"{ISLANDS} SELECT 'orders' AS k, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, length, (SELECT CAST(sum(length) AS BIGINT) FROM sp) AS n_negative FROM sp ORDER BY length DESC, first_day LIMIT 1"),
    "rolling_28_days": (rolling, f"WITH {DAY}, r AS (SELECT day, avg(v) OVER w AS rolling, count(v) OVER w AS n FROM daily WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW)) SELECT 'orders' AS k, CAST(day AS VARCHAR) AS day, round(rolling, 2) AS rolling FROM r WHERE n = 28"),
    "rolling_stats": (rolling_stats, f"WITH {DAY}, r AS (SELECT day, avg(v) OVER w AS rolling, count(v) OVER w AS n FROM daily WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW)) SELECT 'orders' AS k, count(*) AS windows, count(*) FILTER (rolling < 0) AS negative, round(min(rolling), 2) AS lowest, CAST(arg_min(day, rolling) AS VARCHAR) AS lowest_day FROM r WHERE n = 28 HAVING count(*) > 0"),
    "level_shift": (level_shift, f"""WITH {DAY}, r0 AS (SELECT day, avg(v) OVER w AS r, count(v) OVER w AS n FROM daily WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW)), r AS (SELECT day, r FROM r0 WHERE n = 28),
p AS (SELECT a.day, b.r - a.r AS s FROM r a JOIN r b ON b.day = a.day + INTERVAL 29 DAY), o AS (SELECT max(s) FILTER (day = DATE '1997-06-30') AS own FROM p)
SELECT 'orders' AS k, round(max(own), 4) AS shift, count(*) AS placements, round(avg(CASE WHEN abs(s) >= abs(own) THEN 1.0 WHEN own IS NULL THEN NULL ELSE 0.0 END), 4) AS share_as_large FROM p, o HAVING count(*) > 0"""),
    "autocorrelations": (acf, f"WITH {DAY}, x AS (SELECT day, v - avg(v) OVER () AS x FROM daily), l AS (SELECT unnest([1, 7, 30]) AS lag) SELECT 'orders' AS k, lag, round(sum(a.x * b.x) / (SELECT sum(x * x) FROM x), 9) AS acf FROM x a, l JOIN x b ON b.day = a.day + to_days(CAST(lag AS INT)) GROUP BY lag"),
    "ar1_half_life": (ar1, f"WITH {DAY}, p AS (SELECT a.v AS x, b.v AS y FROM daily a JOIN daily b ON b.day = a.day + INTERVAL 1 DAY), g AS (SELECT count(*) AS pairs, regr_slope(y, x) AS phi FROM p) SELECT 'orders' AS k, pairs, round(phi, 7) AS phi, CASE WHEN phi > 0 AND phi < 1 THEN round(ln(0.5) / ln(phi), 7) END AS half_life FROM g"),
    "within_quarter": (within_quarter, f"WITH {DAY} SELECT 'orders' AS k, CAST(day AS VARCHAR) AS day, round(v - avg(v) OVER (PARTITION BY year(day), quarter(day)), 3) + 0 AS within FROM daily"),
    "weekly_means": (weekly_means, f"WITH {DAY} SELECT 'orders' AS k, CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week, round(avg(v), 3) AS mean, count(*) AS n FROM daily GROUP BY 2 HAVING count(*) >= 5"),
    "index_windows": (index_windows, f"""WITH {REC}, {HOURLY_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY venue) AS n FROM hr), w AS (SELECT venue, unnest(range(0, (max(n) - 168) // 48 + 1)) AS w FROM i WHERE n >= 168 GROUP BY 1)
SELECT venue, w AS "window", min(time) AS first_time, max(time) AS last_time, count(*) AS n, round(avg(m), 4) AS mean FROM i JOIN w USING (venue) WHERE i >= w * 48 AND i < w * 48 + 168 GROUP BY 1, 2"""),
    "trailing_means": (trailing, f"WITH {REC}, {HOURLY_SQL} SELECT venue, time, m, CASE WHEN count(m) OVER w = 24 THEN round(avg(m) OVER w, 4) END AS strict, round(avg(m) OVER w, 4) AS trailing FROM hr WINDOW w AS (PARTITION BY venue ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"),
    "median_filter": (median_filter, f"""WITH {REC}, {HOURLY_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY time) AS i, count(*) OVER (PARTITION BY venue) AS n FROM hr), o AS (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS o)
SELECT a.venue, a.time, any_value(a.m) AS m, CAST(median(b.m) AS BIGINT) AS smooth FROM i a, o JOIN i b ON b.venue = a.venue AND b.i = greatest(1, least(a.n, a.i + o)) GROUP BY 1, 2"""),
    "sensitivity_variants": (variants, f"""WITH {REC}, {HOURLY_SQL}, {V}, r AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY m DESC, time) AS rn, quantile_cont(m, 0.99) OVER (PARTITION BY venue) AS cap FROM h), s AS (SELECT *, max(m) FILTER (rn = 2) OVER (PARTITION BY venue) AS second FROM r),
u AS (SELECT venue, unnest(['baseline', 'max_to_second', 'drop_max', 'cap_q99']) AS variant, unnest([m, CASE WHEN rn = 1 THEN second ELSE m END, CASE WHEN rn > 1 THEN m END, least(m, cap)]) AS m FROM s)
SELECT venue, variant, count(*) AS n, round(avg(m), 4) AS mean, round(max(m), 4) AS largest FROM u WHERE m IS NOT NULL GROUP BY 1, 2"""),
    "injected_values": (injected, f"""WITH {REC}, {HOURLY_SQL}, {V}, i AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY time) - 1 AS i, unnest([0, 100, 300]) AS position FROM h), x AS (SELECT venue, position, time, CASE WHEN i = position THEN 99999 ELSE m END AS m FROM i)
SELECT venue, position, count(*) AS n, round(sum(m), 3) AS total, arg_max(time, m) AS top_time FROM x GROUP BY 1, 2"""),
    "trimmed_extremes": (trimmed, f"WITH {REC}, {HOURLY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY abs(m) DESC, time) AS r FROM hr) SELECT venue, count(*) AS n, CAST(sum(m) AS BIGINT) AS total, max(abs(m)) AS largest FROM r WHERE r > 8 GROUP BY 1"),
    "winsorised": (winsorised, f"WITH {REC}, q AS (SELECT venue, quantile_cont(premium_bps, 0.0005) AS lo, quantile_cont(premium_bps, 0.9995) AS hi FROM fund GROUP BY 1), c AS (SELECT venue, greatest(least(premium_bps, hi), lo) AS x FROM fund JOIN q USING (venue)) SELECT venue, round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(avg(x), 6) AS mean FROM c GROUP BY 1"),
    "gaussian_fit": (gaussian, f"WITH {REC}, g AS (SELECT venue, count(*) AS n, avg(premium_bps) AS mu, var_pop(premium_bps) AS var FROM fund GROUP BY 1), l AS (SELECT *, -n / 2.0 * (ln(2 * pi()) + 1 + ln(var)) AS ll FROM g) SELECT venue, n, round(mu, 4) AS mu, round(var, 4) AS var, round(ll, 4) AS loglik, round(4 - 2 * ll, 4) AS aic, round(2 * ln(n) - 2 * ll, 4) AS bic FROM l"),
    "jarque_bera": (jarque_bera, f"WITH {REC}, m AS (SELECT venue, premium_bps - avg(premium_bps) OVER (PARTITION BY venue) AS d FROM fund), g AS (SELECT venue, count(*) AS n, avg(d ** 3) / avg(d ** 2) ** 1.5 AS s, avg(d ** 4) / avg(d ** 2) ** 2 - 3 AS k FROM m GROUP BY 1) SELECT venue, n, round(n / 6.0 * (s * s + k * k / 4), 5) AS jb, round(exp(-n / 12.0 * (s * s + k * k / 4)), 5) AS p FROM g"),
    "ljung_box": (ljung_box, f"""WITH {REC}, {HOURLY_SQL}, x AS (SELECT venue, time, m - avg(m) OVER (PARTITION BY venue) AS d FROM hr), y AS (SELECT venue, d, {LAGS} FROM x), g AS (SELECT venue, count(*) AS n, {LJ} FROM y GROUP BY 1), q AS (SELECT venue, n, 10 AS lag, {LJQ(10)} AS q FROM g UNION ALL SELECT venue, n, 24, {LJQ(24)} FROM g)
SELECT venue, n, lag, round(q, 6) AS q, round(CASE lag WHEN 10 THEN {CHI('q', 10)} ELSE {CHI('q', 24)} END, 6) AS p FROM q"""),
    "hac_slope": (hac, f"""WITH {REC}, x0 AS (SELECT venue, event_id, premium_bps AS y, (event_id * 7919 % 1000) / 100.0::DOUBLE AS x FROM fund), b AS (SELECT *, avg(x) OVER v AS mx, avg(y) OVER v AS my, covar_pop(y, x) OVER v / var_pop(x) OVER v AS b FROM x0 WINDOW v AS (PARTITION BY venue)), s AS (SELECT *, ((y - my) - b * (x - mx)) * (x - mx) AS s FROM b),
m AS (SELECT venue, b, s * (s + {AHEAD}) AS m, (x - mx) ** 2 AS xx FROM s WINDOW w AS (PARTITION BY venue ORDER BY event_id)), g AS (SELECT venue, count(*) AS n, any_value(b) AS slope, sqrt(sum(m)) / sum(xx) AS se FROM m GROUP BY 1)
SELECT venue, n, round(slope, 7) AS slope, round(se, 7) AS se, round(slope - 1.96 * se, 7) AS lo, round(slope + 1.96 * se, 7) AS hi FROM g"""),
    "correlations": (correlations, f"""WITH {REC}, {HOURLY_SQL}, j AS (SELECT b.venue, a.m AS a, b.m AS b FROM hr a JOIN hr b ON a.time = b.time AND a.venue = 'click' AND b.venue <> 'click'), r AS (SELECT *, rank() OVER (PARTITION BY venue ORDER BY a) + (count(*) OVER (PARTITION BY venue, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY venue ORDER BY b) + (count(*) OVER (PARTITION BY venue, b) - 1) / 2.0 AS rb FROM j)
SELECT venue, count(*) AS n, round(corr(a, b), 8) AS pearson, round(corr(ra, rb), 8) AS spearman FROM r GROUP BY 1"""),
    "arch_lm": (arch, None),
    "bootstrap_median": (bootstrap_median, None),
}
