"""Acceptance of panels, intervals by period, and tables that put fits side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import markov as M, panel as J, stats as T, switching as W
from tidemark.plans import models
from tidemark.plans.tables import HOURLY_SQL, RECORDS_SQL as REC, hourly, records, rounded


def acceptance(spark, d):
    """Whether one venue's hours may stand for another's: overlap and largest difference per field, against limits."""
    h = records(spark, d).groupBy("venue", "time").agg(F.sum("p").alias("total"), F.count("*").alias("n"), F.max("p").alias("most"))
    one = lambda v: h.where(F.col("venue") == v).drop("venue")
    return rounded(J.accepted(one("click"), one("view"), [], {"total": 40_000.0, "n": 5.0, "most": 1e9}, 0.5), "largest", "overlap")


def injection_times(spark, d):
    """The stamps at places 0, 100 and 300 of each venue's hours."""
    return T.numbered(hourly(spark, d), ["venue"], "time", "position").where(F.col("position").isin(0, 100, 300)).select("venue", F.col("position").cast("long").alias("position"), "time")


def upper_tail(spark, d):
    v = T.upper_tail_variants(models.rows(spark, d), ["venue"], "v", "time", "2024-01-10", "2024-01-20")
    return rounded(v.groupBy("venue", "variant").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("largest")), "mean", "largest")


def pricing_check(spark, d):
    """Daily means of one venue against those of the others: correlations, and the slope with its HAC error, of the means and of what lies within weeks."""
    day = hourly(spark, d).groupBy("venue", F.date_trunc("day", "time").alias("time")).agg(F.avg("m").alias("m"))
    both = day.where("venue <> 'click'").withColumnRenamed("m", "y").join(day.where("venue = 'click'").select("time", F.col("m").alias("x")), "time")
    week = both.groupBy("venue", F.date_trunc("week", "time").alias("week")).agg(F.avg("x").alias("_wx"), F.avg("y").alias("_wy"))
    net = both.withColumn("week", F.date_trunc("week", "time")).join(week, ["venue", "week"]).select("venue", "time", (F.col("x") - F.col("_wx")).alias("x"), (F.col("y") - F.col("_wy")).alias("y"))
    slope = lambda r, p: T.hac_slope(r, ["venue"], "y", "x", "time", HAC_DAYS).select("venue", F.col("slope").alias(f"{p}slope"), F.col("se").alias(f"{p}se"), F.col("lo").alias(f"{p}lo"), F.col("hi").alias(f"{p}hi"))
    found = T.correlations(both, ["venue"], "x", "y").join(slope(both, ""), "venue").join(slope(net, "within_"), "venue")
    return rounded(found, *(c for c in found.columns if c not in ("venue", "n")), digits=6)


def median_intervals(spark, d):
    """Bootstrap intervals of each week's median for blocks of 24, 72 and 168 hours, and which of them hold 0 only with some blocks."""
    h = hourly(spark, d).withColumns({"m": F.col("m").cast("double"), "week": F.date_format(F.date_trunc("week", F.col("time")), "yyyy-MM-dd")})
    out = None
    for block in (24, 72, 168):
        one = T.block_bootstrap_median(h, ["venue", "week"], "m", "time", block, 2000).withColumn("block", F.lit(block))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("holds_zero", (F.col("lo") <= 0) & (F.col("hi") >= 0)).groupBy("venue", "week", "n", "median").agg(F.min("lo").alias("lowest"), F.max("hi").alias("highest"), F.count_if("holds_zero").alias("blocks_holding_zero"))


def hmm_winsorised(spark, d):
    """Three states of each venue's hours as they are, and clipped at their outermost quantiles."""
    r = models.rows(spark, d)
    capped = T.winsorised(r, ["venue"], "v").select("venue", "time", F.col("capped").alias("v"), F.lit("winsorised").alias("variant"))
    both = r.withColumn("variant", F.lit("raw")).unionByName(capped)
    keys = ["venue", "variant"]
    m = M.best(M.fit(M.as_arrays(both, keys, "v", "time"), keys, (3,), models.STARTS, models.CAP, models.TOL), keys)
    return m.select(*keys, "n", "ll", "mu", "sigma", M.durations().alias("durations"))


def two_hour_chain(spark, d):
    """Three states of the two-hour means."""
    two = hourly(spark, d).groupBy("venue", F.window("time", "2 hours").start.alias("time")).agg((F.avg("m") / 1000).alias("v"))
    m = M.best(M.fit(M.as_arrays(two, ["venue"], "v", "time"), ["venue"], (3,), models.STARTS, models.CAP, models.TOL), ["venue"])
    return m.select("venue", "n", "ll", "mu", "sigma", "a")


def switching_on_rate(spark, d):
    """Why the switching fit takes premiums: on the rates themselves, which stand at the floor, starts collapse."""
    rate = records(spark, d).groupBy("venue", "time").agg((F.max_by("r", "ts") / 1000).alias("v"))
    fits = W.admissible(W.fit_switching(M.as_arrays(rate, ["venue"], "v", "time"), ["venue"], 10))
    return fits.groupBy("venue", F.coalesce("excluded", F.lit("usable")).alias("outcome")).agg(F.count("*").alias("starts"), F.min(F.least("var0", "var1")).alias("least_variance"))


def switching_at_optima(spark, d):
    """Half-lives at every optimum that starts of the switching fit reached, not only at the best."""
    fits = W.admissible(models.regimes(spark, d)).where("excluded is null").withColumn("optimum", F.round("ll", 2))
    one = fits.groupBy("venue", "optimum").agg(F.count("*").alias("starts"), F.min_by(F.struct("phi0", "phi1", "p00", "p11"), "start").alias("m"))
    half = lambda c: F.when((F.abs(c) > 0) & (F.abs(c) < 1), F.lit(-0.6931471805599453) / F.ln(F.abs(c)))
    return one.select("venue", "optimum", "starts", half(F.col("m.phi0")).alias("half_life0"), half(F.col("m.phi1")).alias("half_life1"), F.col("m.p00").alias("p00"), F.col("m.p11").alias("p11"))


def forest(spark, d):
    """Ratios of half-lives with their intervals from the whole series, its windows and its variants, one below the other; open ends are marked."""
    variant = F.concat(F.lit("variant "), "variant")
    labels = F.when(F.col("variant") == "baseline", F.array(F.lit("whole"), variant)).otherwise(F.array(variant))  # the baseline is the whole series: one fit for both
    label = lambda df, c: df.select("venue", F.explode(c).alias("label"), "ratio", "linear", "wald")
    rows = label(models.switching_sensitivity(spark, d), labels).unionByName(label(models.switching_rolling(spark, d), F.array(F.concat(F.lit("window "), F.col("window").cast("string")))))
    return rows.select("venue", "label", "ratio", F.col("linear.lo").alias("lo"), F.col("linear.hi").alias("hi"), (F.col("linear.lo") <= 0).alias("open_below"), F.col("linear").isNull().alias("undefined"), F.col("wald.side").alias("side"))


def chains_on_garch(spark, d):
    return W.chains_on_garch(models.garch(spark, d).where("dist = 'normal'"), ["venue"])


def transition_geometry(spark, d):
    """Each transition of the two-state chain with its bootstrap interval."""
    return models.hmm_bootstrap(spark, d).where("labels = 'sigma' and parameter like 'a\\\\_%'").select("venue", F.split_part("parameter", F.lit("_"), F.lit(2)).cast("int").alias("from_state"), F.split_part("parameter", F.lit("_"), F.lit(3)).cast("int").alias("to_state"), "point", "lo", "hi", "at_zero")


HAC_DAYS = 20  # days of Newey-West weights
DAYS = f"WITH {REC}, {HOURLY_SQL}, dy AS (SELECT venue, date_trunc('day', time) AS time, avg(m) AS m FROM hr GROUP BY 1, 2)"

AHEAD = " + ".join(f"2 * (1 - {k} / {HAC_DAYS + 1}.0) * coalesce(lead(s, {k}) OVER w, 0)" for k in range(1, HAC_DAYS + 1))


def hac_sql(name: str, x: str, y: str) -> str:
    """The slope of y on x by venue in order of time, with its HAC error, as a table ``name``."""
    return f"""{name}0 AS (SELECT venue, time, b, {x} - mx AS e, (({y} - my) - b * ({x} - mx)) * ({x} - mx) AS s FROM (SELECT *, avg({x}) OVER v AS mx, avg({y}) OVER v AS my, covar_pop({y}, {x}) OVER v / var_pop({x}) OVER v AS b FROM r WINDOW v AS (PARTITION BY venue)) z),
{name}1 AS (SELECT venue, b, e * e AS xx, s * (s + {AHEAD}) AS m FROM {name}0 WINDOW w AS (PARTITION BY venue ORDER BY time)),
{name}2 AS (SELECT venue, any_value(b) AS slope, sqrt(greatest(sum(m), 0)) / sum(xx) AS se FROM {name}1 GROUP BY 1), {name} AS (SELECT *, slope - 1.96 * se AS lo, slope + 1.96 * se AS hi FROM {name}2)"""


QUERIES = {
    "panel_acceptance": (acceptance, f"""WITH {REC}, h AS (SELECT venue, time, CAST(sum(p) AS BIGINT) AS total, count(*) AS n, max(p) AS most FROM fund GROUP BY 1, 2), j AS (SELECT a.time, abs(a.total - b.total) AS total, abs(a.n - b.n) AS n, abs(a.most - b.most) AS most FROM h a JOIN h b ON a.time = b.time AND a.venue = 'click' AND b.venue = 'view'),
l AS (SELECT unnest(['total', 'n', 'most']) AS field, unnest([total, n, most]) AS diff, unnest([40000.0, 5.0, 1e9]) AS most_allowed FROM j), s AS (SELECT count(*) AS n_right FROM h WHERE venue = 'view')
SELECT field, count(*) AS matched, round(max(diff), 6) AS largest, round(count(*) / any_value(n_right), 6) AS overlap, count(*) / any_value(n_right) >= 0.5 AND max(diff) <= any_value(most_allowed) AS accepted FROM l, s GROUP BY field"""),
    "injection_times": (injection_times, f"WITH {REC}, {HOURLY_SQL}, i AS (SELECT venue, time, row_number() OVER (PARTITION BY venue ORDER BY time) - 1 AS position FROM hr) SELECT venue, position, time FROM i WHERE position IN (0, 100, 300)"),
    "upper_tail": (upper_tail, f"""WITH {REC}, {HOURLY_SQL}, h AS (SELECT venue, time, m / 1000.0::DOUBLE AS v FROM hr), c AS (SELECT venue, quantile_cont(v, 0.99) AS cap FROM h GROUP BY 1), x AS (SELECT venue, time, v, least(v, cap) AS w FROM h JOIN c USING (venue)),
u AS (SELECT venue, 'tail_capped_within' AS variant, CASE WHEN time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-20' THEN w ELSE v END AS v FROM x UNION ALL SELECT venue, 'capped_from', w FROM x WHERE time >= TIMESTAMP '2024-01-20')
SELECT venue, variant, count(*) AS n, round(avg(v), 6) AS mean, round(max(v), 6) AS largest FROM u GROUP BY 1, 2"""),
    "pricing_check": (pricing_check, f"""{DAYS}, j AS (SELECT b.venue, b.time, a.m AS x, b.m AS y FROM dy a JOIN dy b ON a.time = b.time AND a.venue = 'click' AND b.venue <> 'click'), r AS (SELECT *, rank() OVER (PARTITION BY venue ORDER BY x) + (count(*) OVER (PARTITION BY venue, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY venue ORDER BY y) + (count(*) OVER (PARTITION BY venue, y) - 1) / 2.0 AS ry,
x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM j WINDOW w AS (PARTITION BY venue, date_trunc('week', time))), c AS (SELECT venue, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1), {hac_sql("a", "x", "y")}, {hac_sql("b", "dx", "dy")}
SELECT c.*, {", ".join(f"round({t}.{c}, 6) + 0.0 AS {p}{c}" for t, p in (("a", ""), ("b", "within_")) for c in ("slope", "se", "lo", "hi"))} FROM c JOIN a USING (venue) JOIN b USING (venue)"""),
} | {f.__name__: (f, None) for f in (median_intervals, hmm_winsorised, two_hour_chain, switching_on_rate, switching_at_optima, forest, chains_on_garch, transition_geometry)}
