"""Queries on the funding rule and the floor."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import funding as X, periods as P, ratios as R
from tidemark.operators import censoring as C, islands as I
from tidemark.plans.tables import RECORDS_SQL as REC, records, rounded

SPANS = (("first", "2024-01-01 00:00:00", "2024-01-10 12:00:00", True), ("second", "2024-01-10 12:00:00", "2024-01-20 00:00:00", False), ("whole", "2024-01-01 00:00:00", "2024-01-31 00:00:00", True))
SPANS_SQL = "spans AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}', {str(c).lower()})" for n, a, b, c in SPANS) + ") t(name, lo, hi, left_closed))"
SIDES = "count(*) AS n, count(*) FILTER (r < 1000) AS below, count(*) FILTER (r = 1000) AS at, count(*) FILTER (r > 1000) AS above"
FLOOR = X.literal


def floor_share_by_phase(spark, d):
    rows = records(spark, d)
    out = C.phase_shares(rows, ["venue"], F.col("rate") == FLOOR(X.FLOOR_8H), (F.hour("time") % 8).cast("int"))
    return rounded(out, "share", "smallest", "largest", digits=9)


def funding_rule(spark, d):
    p = F.col("premium_bps")
    out = records(spark, d).select("event_id", X.funding_8h(p, F.lit(1.0), F.lit(5.0)).alias("funding_8h_bps"), X.hourly_bps(p).alias("hourly_bps"), X.clamp_binds(X.hourly_bps(p)).alias("binds"), X.in_band(p).alias("in_band"))
    return rounded(out, "funding_8h_bps", "hourly_bps")


def recovered_premium(spark, d):
    out = records(spark, d).select("event_id", "venue", X.recovered_premium_bps(F.col("rate")).alias("recovered_bps"), (F.col("rate") == FLOOR(X.FLOOR_8H)).alias("at_floor"))
    return rounded(out, "recovered_bps")


def floor_counts(spark, d):
    out = C.floor_counts(records(spark, d), ["venue"], F.col("rate"), FLOOR(X.FLOOR_8H))
    return rounded(out, "share_below", "share_at", "share_above", digits=9)


def printed_rates(spark, d):
    """Rates in several printed forms, compared exactly."""
    e = records(spark, d).select("event_id", "rate")
    forms = F.array(F.format_string("%.12f", F.col("rate").cast("double")), F.concat(F.lit(" "), F.col("rate").cast("string"), F.lit(" ")), F.format_string("%.11e", F.col("rate").cast("double")))
    return e.select("event_id", F.forall(forms, lambda s: X.rate(s) == F.col("rate")).alias("all_equal"))


def span_floor_counts(spark, d):
    rows = P.in_spans(records(spark, d), P.spans(spark, SPANS), "ts")
    out = C.floor_counts(rows, ["span", "venue"], F.col("rate"), FLOOR(X.FLOOR_8H)).select("span", "venue", "n", "below", "at", "above")
    labels = P.spans(spark, SPANS).select(F.col("name").alias("span"), P.span_label(F.col("lo"), F.col("hi")).alias("label"))
    return out.join(F.broadcast(labels), "span")  # a row per span


def settlement_venues(spark, d):
    """Every venue, and each read at settlement stamps only as a venue of its own."""
    rows = records(spark, d)
    both = rows.unionByName(rows.where(X.at_settlement(F.col("ts"))).withColumn("venue", F.concat("venue", F.lit("_8h"))))
    return C.floor_counts(both, ["venue"], F.col("rate"), FLOOR(X.FLOOR_8H)).select("venue", "n", "below", "at", "above")


def floor_by_period(spark, d):
    levels = {f: P.period(F.col("ts"), f) for f in ("Y", "H", "Q", "M", "D")}
    return C.floor_summary_by_period(records(spark, d), ["venue"], levels, F.col("rate"), FLOOR(X.FLOOR_8H))


def period_bounds(spark, d):
    rows = records(spark, d)
    parts = None
    for f in ("Y", "H", "Q", "M"):
        lo, hi = P.period_bounds(F.col("ts"), f)
        one = rows.select(F.lit(f).alias("freq"), P.period(F.col("ts"), f).alias("period"), lo.alias("lo"), hi.alias("hi")).groupBy("freq", "period", "lo", "hi").agg(F.count("*").alias("n"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def rank_of_venues(spark, d):
    day = P.period(F.col("ts"), "D")
    shares = C.floor_counts(records(spark, d).withColumn("period", day), ["period", "venue"], F.col("rate"), FLOOR(X.FLOOR_8H)).select("period", "venue", F.col("share_at").alias("share"))
    return rounded(C.rank_against(shares, ["period"], "click"), "mine", "lowest", "highest", digits=9)


def last_run(spark, d):
    return I.last_run_start(rank_of_venues(spark, d).withColumn("k", F.lit(1)), ["k"], value="between").select("run_start", F.col("run_length").cast("long").alias("run_length"))


def censored_quantiles(spark, d):
    rows = records(spark, d).withColumn("bps", X.recovered_premium_bps(F.col("rate")))
    q = C.censored_quantiles(rows, ["venue"], "bps", (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))
    return rounded(q, "q")


def premium_location(spark, d):
    return rounded(C.location(records(spark, d), ["venue"], "premium_bps"), "mean", "sd", "share_in_band")


def describe(spark, d):
    return rounded(C.describe(records(spark, d), ["venue"], "premium_bps"), "mean", "sd", "min", "median", "max", "skew", "excess_kurtosis")


def rule_records(spark, d, places=False):
    """Hourly records of each venue under two clamps and none, by third of the hours, classified."""
    from pyspark.sql import Window

    h = records(spark, d).groupBy("venue", "time").agg(F.min_by("p", "ts").alias("p"))
    part = F.ntile(3).over(Window.partitionBy("venue").orderBy("time"))
    c = F.when(F.col("_part") == 1, 3000).when(F.col("_part") == 2, 100000000).otherwise(5000)
    r8 = F.col("p") + F.greatest(F.least(1000 - F.col("p"), c), -c)
    exact = lambda x, k: (x.cast("decimal(12,0)") * F.lit(k).cast("decimal(11,10)")).cast(X.RATE)
    h = h.withColumn("_part", part).withColumn("r8", F.when(F.col("_part") == 2, F.col("p")).otherwise(r8))
    h = h.select("venue", "time", "p", "r8", exact(F.col("r8") * 125, "0.0000000001").alias("rate"), exact(F.col("p") * 1000, "0.0000000001").alias("premium"))
    return I.rule_records(h, ["venue"], places=places)


def rule_classes(spark, d):
    return rule_records(spark, d).groupBy("venue", "schedule", "regime").agg(F.count("*").alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def rule_switch(spark, d):
    return I.switch(rule_records(spark, d), ["venue"])


def rule_eras(spark, d):
    return I.eras(rule_records(spark, d, places=True), ["venue"])


def ratio_sets(spark, d):
    """Confidence sets of ratios, on coefficients made from the events."""
    rows = records(spark, d).select("event_id", (0.1 + F.pmod("p", F.lit(800)) / 1000.0).alias("a"), (0.1 + F.pmod(F.col("p") * 7, F.lit(850)) / 1000.0).alias("b"), (0.0001 + F.pmod(F.col("p") * 3, F.lit(400)) / 10000.0).alias("va"), (0.0001 + F.pmod(F.col("p") * 5, F.lit(400)) / 10000.0).alias("vb"))
    s = R.fieller(F.col("a"), F.col("b"), F.col("va"), F.col("vb"), F.lit(0.0))
    out = rows.withColumn("s", s).select("event_id", F.col("s.shape").alias("shape"), F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), R.side_of_unity(F.col("s")).alias("side"), R.half_life(F.col("a")).alias("half_life"), R.half_life_slope(F.col("a")).alias("slope"), R.stationary2(F.col("a"), F.col("b")).alias("stationary"), R.expected_duration(F.col("a")).alias("duration"))
    return rounded(out, "lo", "hi", "half_life", "slope", "stationary", "duration", digits=5)


RULES_SQL = f"""WITH {REC},
h0 AS (SELECT venue, time, arg_min(p, ts) AS p FROM fund GROUP BY venue, time),
h1 AS (SELECT *, ntile(3) OVER (PARTITION BY venue ORDER BY time) AS part, epoch(time) AS s FROM h0),
h2 AS (SELECT *, CASE part WHEN 2 THEN p WHEN 1 THEN p + greatest(least(1000 - p, 3000), -3000) ELSE p + greatest(least(1000 - p, 5000), -5000) END AS r8,
  coalesce(s - lag(s) OVER w, lead(s) OVER w - s) >= 14400 AS long FROM h1 WINDOW w AS (PARTITION BY venue ORDER BY time)),
h3 AS (SELECT *, CASE WHEN long THEN '8h' ELSE '1h' END AS schedule, CASE WHEN long THEN r8 / 8.0 ELSE r8 END AS eff FROM h2),
cls AS (SELECT venue, time, p, schedule, CASE WHEN CASE WHEN long THEN r8 = 8000 ELSE r8 = 1000 END THEN 'floor' WHEN abs(abs(eff - p) - 5000) <= 0.1 THEN 'clamp_5bp' WHEN abs(abs(eff - p) - 3000) <= 0.1 THEN 'clamp_3bp' WHEN abs(eff - p) <= 0.1 THEN 'unclamped' ELSE 'other' END AS regime FROM h3)"""

ERAS_SQL = f"""{RULES_SQL},
k AS (SELECT *, CASE WHEN regime IN ('clamp_3bp', 'clamp_5bp', 'unclamped') THEN schedule || ' ' || regime END AS mark FROM cls),
b AS (SELECT *, last_value(mark IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bk, first_value(mark IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ah, count(mark) OVER (w ROWS UNBOUNDED PRECEDING) AS stretch FROM k WINDOW w AS (PARTITION BY venue ORDER BY time)),
n AS (SELECT *, split_part(bk, ' ', 1) AS bs, split_part(bk, ' ', 2) AS br, split_part(ah, ' ', 1) AS hs, split_part(ah, ' ', 2) AS hr, max(CASE WHEN mark IS NULL AND schedule = split_part(ah, ' ', 1) THEN 1 END) OVER (PARTITION BY venue, stretch ORDER BY time ROWS UNBOUNDED PRECEDING) AS new FROM b),
e AS (SELECT *, CASE WHEN mark IS NOT NULL THEN mark WHEN bk IS NULL THEN ah WHEN ah IS NULL OR bk = ah THEN bk WHEN bs <> hs THEN CASE WHEN new = 1 THEN ah ELSE bk END WHEN br = 'unclamped' THEN ah ELSE bk END AS era_of, mark IS NULL AND bk <> ah AND bs = hs AND br <> 'unclamped' AND hr <> 'unclamped' AS open FROM n),
c AS (SELECT *, CASE WHEN era_of IS DISTINCT FROM lag(era_of) OVER (PARTITION BY venue ORDER BY time) THEN 1 ELSE 0 END AS ch FROM e),
r AS (SELECT *, sum(ch) OVER (PARTITION BY venue ORDER BY time ROWS UNBOUNDED PRECEDING) AS era, CASE split_part(era_of, ' ', 2) WHEN 'clamp_3bp' THEN p BETWEEN -2000 AND 4000 WHEN 'clamp_5bp' THEN p BETWEEN -4000 AND 6000 END AS inb FROM c)
SELECT venue, CAST(era AS BIGINT) AS era, split_part(any_value(era_of), ' ', 1) AS schedule, split_part(any_value(era_of), ' ', 2) AS rule, min(time) AS first_time, max(time) AS last_time, count(*) AS n_records, count(*) FILTER (regime = 'floor') AS n_floor, count(*) FILTER (regime = 'other') AS n_other,
count(*) FILTER (regime = 'floor' AND coalesce(NOT inb, true)) AS floor_not_in_band, count(*) FILTER (regime <> 'floor' AND inb) AS in_band_not_floor, count(*) FILTER (open) AS undetermined_after FROM r GROUP BY venue, era"""

QUERIES = {
    "floor_share_by_phase": (floor_share_by_phase, f"""WITH {REC}, g AS (SELECT venue, CAST(hour(time) % 8 AS INT) AS phase, count(*) AS n, avg(CASE WHEN r = 1000 THEN 1.0 ELSE 0.0 END) AS share FROM fund GROUP BY 1, 2)
SELECT venue, phase, n, round(share, 9) AS share, round(min(share) OVER (PARTITION BY venue), 9) AS smallest, round(max(share) OVER (PARTITION BY venue), 9) AS largest FROM g"""),
    "funding_rule": (funding_rule, f"WITH {REC} SELECT event_id, round(r / 1000.0, 6) AS funding_8h_bps, round(r / 8000.0, 6) AS hourly_bps, abs(r / 8000.0 - 0.125) < 0.001 AS binds, CASE WHEN p BETWEEN -4000 AND 6000 THEN 1.0::DOUBLE ELSE 0.0 END AS in_band FROM fund"),
    "recovered_premium": (recovered_premium, f"WITH {REC} SELECT event_id, venue, CASE WHEN r < 1000 THEN round((r - 5000) / 1000.0, 6) WHEN r > 1000 THEN round((r + 5000) / 1000.0, 6) END AS recovered_bps, r = 1000 AS at_floor FROM fund"),
    "floor_counts": (floor_counts, f"WITH {REC}, g AS (SELECT venue, {SIDES} FROM fund GROUP BY 1) SELECT *, round(below / n, 9) AS share_below, round(g.at / n, 9) AS share_at, round(above / n, 9) AS share_above FROM g"),
    "printed_rates": (printed_rates, "SELECT event_id, true AS all_equal FROM events"),
    "span_floor_counts": (span_floor_counts, f"WITH {REC}, {SPANS_SQL} SELECT name AS span, venue, {SIDES}, strftime(any_value(lo), '%Y-%m-%d') || ' to ' || strftime(any_value(hi) - INTERVAL 1 MINUTE, '%Y-%m-%d') AS label FROM fund JOIN spans ON ts <= hi AND (ts > lo OR (left_closed AND ts = lo)) GROUP BY 1, 2"),
    "settlement_venues": (settlement_venues, f"WITH {REC}, b AS (SELECT venue, r FROM fund UNION ALL SELECT venue || '_8h', r FROM fund WHERE hour(ts) IN (0, 8, 16) AND minute(ts) = 0) SELECT venue, {SIDES} FROM b GROUP BY 1"),
    "floor_by_period": (floor_by_period, f"""WITH {REC}, k AS (SELECT *, ts - INTERVAL 1 SECOND AS t FROM fund), l AS (SELECT venue, r, unnest(['Y', 'H', 'Q', 'M', 'D']) AS level, unnest([CAST(year(t) AS VARCHAR), year(t) || CASE WHEN month(t) <= 6 THEN 'H1' ELSE 'H2' END, year(t) || 'Q' || quarter(t), strftime(t, '%Y-%m'), strftime(t, '%Y-%m-%d')]) AS period FROM k)
SELECT venue, level, period, {SIDES} FROM l GROUP BY 1, 2, 3"""),
    "period_bounds": (period_bounds, f"""WITH {REC}, k AS (SELECT ts - INTERVAL 1 SECOND AS t FROM fund), l AS (
SELECT 'Y' AS freq, CAST(year(t) AS VARCHAR) AS period, date_trunc('year', t) AS lo, 12 AS m FROM k UNION ALL SELECT 'H', year(t) || CASE WHEN month(t) <= 6 THEN 'H1' ELSE 'H2' END, date_trunc('year', t) + to_months(CAST(CASE WHEN month(t) <= 6 THEN 0 ELSE 6 END AS INT)), 6 FROM k
UNION ALL SELECT 'Q', year(t) || 'Q' || quarter(t), date_trunc('quarter', t), 3 FROM k UNION ALL SELECT 'M', strftime(t, '%Y-%m'), date_trunc('month', t), 1 FROM k)
SELECT freq, period, CAST(lo AS TIMESTAMP) AS lo, CAST(lo + to_months(CAST(m AS INT)) AS TIMESTAMP) AS hi, count(*) AS n FROM l GROUP BY 1, 2, 3, 4"""),
    "rank_of_venues": (rank_of_venues, f"""WITH {REC}, s AS (SELECT strftime(ts - INTERVAL 1 SECOND, '%Y-%m-%d') AS period, venue, avg(CASE WHEN r = 1000 THEN 1.0 ELSE 0.0 END) AS share FROM fund GROUP BY 1, 2),
g AS (SELECT period, max(share) FILTER (venue = 'click') AS mine, min(share) FILTER (venue <> 'click') AS lowest, max(share) FILTER (venue <> 'click') AS highest FROM s GROUP BY 1)
SELECT period, round(mine, 9) AS mine, round(lowest, 9) AS lowest, round(highest, 9) AS highest, CASE WHEN mine > highest THEN 'above_all' WHEN mine < lowest THEN 'below_all' WHEN mine IS NOT NULL AND lowest IS NOT NULL THEN 'between' END AS rank FROM g"""),
    "last_run": (last_run, f"""WITH {REC}, s AS (SELECT strftime(ts - INTERVAL 1 SECOND, '%Y-%m-%d') AS period, venue, avg(CASE WHEN r = 1000 THEN 1.0 ELSE 0.0 END) AS share FROM fund GROUP BY 1, 2),
g AS (SELECT period, max(share) FILTER (venue = 'click') AS mine, min(share) FILTER (venue <> 'click') AS lowest, max(share) FILTER (venue <> 'click') AS highest FROM s GROUP BY 1),
k AS (SELECT period, coalesce(mine >= lowest AND mine <= highest, false) AS good FROM g), b AS (SELECT max(period) FILTER (NOT good) AS broken FROM k)
SELECT min(period) AS run_start, count(*) AS run_length FROM k, b WHERE broken IS NULL OR period > broken"""),
    "censored_quantiles": (censored_quantiles, f"""WITH {REC}, v AS (SELECT venue, CASE WHEN r < 1000 THEN (r - 5000) / 1000.0::DOUBLE WHEN r > 1000 THEN (r + 5000) / 1000.0::DOUBLE END AS x FROM fund),
o AS (SELECT venue, x, row_number() OVER (PARTITION BY venue ORDER BY coalesce(x, 1.0), x IS NULL) - 1 AS i, count(*) OVER (PARTITION BY venue) AS n FROM v),
q AS (SELECT *, unnest([0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]::DOUBLE[]) AS p FROM o), h AS (SELECT *, (n - 1) * p AS h, floor((n - 1) * p + 1e-12) AS lo, ceil((n - 1) * p - 1e-12) AS hi FROM q)
SELECT venue, p, CASE WHEN count(*) FILTER (i IN (lo, hi) AND x IS NULL) = 0 THEN round(max(x) FILTER (i = lo) + (max(x) FILTER (i = hi) - max(x) FILTER (i = lo)) * (max(h) - max(lo)), 6) END AS q, max(n) AS n FROM h GROUP BY venue, p"""),
    "premium_location": (premium_location, f"WITH {REC} SELECT venue, count(*) AS n, round(avg(premium_bps), 6) AS mean, round(stddev_samp(premium_bps), 6) AS sd, round(avg(CASE WHEN p BETWEEN -4000 AND 6000 THEN 1.0 ELSE 0.0 END), 6) AS share_in_band FROM fund GROUP BY 1"),
    "describe": (describe, f"""WITH {REC}, m AS (SELECT *, avg(premium_bps) OVER (PARTITION BY venue) AS mu FROM fund), g AS (SELECT venue, count(*) AS n, avg(premium_bps) AS mean, stddev_samp(premium_bps) AS sd, min(premium_bps) AS mn, median(premium_bps) AS md, max(premium_bps) AS mx, avg((premium_bps - mu) ** 2) AS m2, avg((premium_bps - mu) ** 3) AS m3, avg((premium_bps - mu) ** 4) AS m4 FROM m GROUP BY 1)
SELECT venue, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mn, 6) AS "min", round(md, 6) AS median, round(mx, 6) AS "max", round(m3 / m2 ** 1.5, 6) AS skew, round(m4 / m2 ** 2 - 3, 6) AS excess_kurtosis FROM g"""),
    "rule_classes": (rule_classes, f"{RULES_SQL} SELECT venue, schedule, regime, count(*) AS n, min(time) AS first_time, max(time) AS last_time FROM cls GROUP BY 1, 2, 3"),
    "rule_switch": (rule_switch, f"""{RULES_SQL}, f AS (SELECT *, min(time) FILTER (regime = 'clamp_5bp') OVER (PARTITION BY venue) AS sw, p BETWEEN -4000 AND 6000 AS inb FROM cls)
SELECT venue, any_value(sw) AS switch_time, max(time) FILTER (time < sw) AS last_before, count(*) FILTER (schedule = '8h') AS eight_hourly, count(*) FILTER (time >= sw AND regime IN ('clamp_3bp', 'unclamped')) AS late_old, count(*) FILTER (time >= sw AND schedule = '1h') AS common_hours, count(*) FILTER (time >= sw AND schedule = '1h' AND regime = 'floor') AS common_floor, count(*) FILTER (time >= sw AND schedule = '1h' AND regime = 'floor' AND NOT inb) AS common_floor_not_in_band, count(*) FILTER (time >= sw AND schedule = '1h' AND regime <> 'floor' AND inb) AS common_in_band_not_floor, count(*) FILTER (time >= sw AND schedule = '1h' AND regime NOT IN ('floor', 'clamp_5bp')) AS common_other FROM f GROUP BY 1"""),
    "rule_eras": (rule_eras, ERAS_SQL),
    "ratio_sets": (ratio_sets, f"""WITH {REC}, c AS (SELECT event_id, 0.1::DOUBLE + (((p % 800) + 800) % 800) / 1000.0::DOUBLE AS a, 0.1::DOUBLE + (((p * 7 % 850) + 850) % 850) / 1000.0::DOUBLE AS b, 0.0001::DOUBLE + (((p * 3 % 400) + 400) % 400) / 10000.0::DOUBLE AS va, 0.0001::DOUBLE + (((p * 5 % 400) + 400) % 400) / 10000.0::DOUBLE AS vb FROM fund),
z AS (SELECT *, b * b - {R.Z95 ** 2} * vb AS q, a * b AS m, a * a - {R.Z95 ** 2} * va AS cc FROM c), y AS (SELECT *, m * m - q * cc AS root FROM z),
x AS (SELECT *, CASE WHEN q > 0 AND root >= 0 THEN 'bounded' WHEN q < 0 AND root > 0 THEN 'two_rays' WHEN q < 0 THEN 'whole_line' ELSE 'undefined' END AS shape, (m - sqrt(greatest(root, 0))) / q AS l, (m + sqrt(greatest(root, 0))) / q AS h FROM y),
w AS (SELECT *, CASE WHEN shape IN ('bounded', 'two_rays') THEN least(l, h) END AS lo, CASE WHEN shape IN ('bounded', 'two_rays') THEN greatest(l, h) END AS hi FROM x)
SELECT event_id, shape, round(lo, 5) AS lo, round(hi, 5) AS hi, CASE WHEN shape = 'whole_line' THEN 'ns' WHEN lo IS NULL THEN 'undetermined' WHEN shape = 'bounded' THEN CASE WHEN hi <= 0 THEN 'undetermined' WHEN lo > 1 THEN 'above' WHEN hi < 1 THEN 'below' ELSE 'ns' END WHEN lo <= 0 THEN CASE WHEN hi > 1 THEN 'above' ELSE 'ns' END WHEN lo < 1 AND hi > 1 THEN 'undetermined' ELSE 'ns' END AS side,
round(ln(0.5) / ln(a), 5) AS half_life, round(-ln(0.5) / (a * ln(a) ** 2), 5) AS slope, round((1 - b) / (2 - a - b), 5) AS stationary, round(1 / (1 - a), 5) AS duration FROM w"""),
}
