"""Queries that carry state along whole series, in blocks over all tasks: hidden chains with given laws, a variance recursion, marks and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scan as S
from tidemark.plans.tables import HOURLY_SQL, RECORDS_SQL as REC, hourly, records, rounded

BLOCK = 168  # rows of a block: a week of hours; results do not depend on it
STAY, CALM, WIDE, SHIFT = (0.95, 0.9), 0.6, 1.5, 0.5  # of the two-state law: by each venue's mean and deviation
OMEGA, ALPHA, BETA, START = 0.05, 0.1, 0.85, 1.0
ROUNDS = 5  # of EM in chain_fit
KEYS = ["venue"]


def rows(spark, d):
    return hourly(spark, d).select("venue", "time", (F.col("m") / 1000.0).alias("v"))


def laws(spark, d):
    """A calm and a wide state per venue."""
    g = rows(spark, d).groupBy("venue").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).where("s > 0")
    pair = lambda a, b: F.array(a, b)
    (p, q), lit = STAY, F.lit
    return g.select("venue", pair(lit(0.5), lit(0.5)).alias("pi"), pair(pair(lit(p), lit(1 - p)), pair(lit(1 - q), lit(q))).alias("a"), pair(F.col("m"), F.col("m") + SHIFT * F.col("s")).alias("mu"), pair(CALM * F.col("s"), WIDE * F.col("s")).alias("sigma"))


def chain_loglik(spark, d):
    blocks = S.series_blocks(rows(spark, d), KEYS, "v", "time", BLOCK)
    return rounded(S.chain_loglik(blocks, laws(spark, d), KEYS), "ll")


def chain_states(spark, d):
    s = S.chain_states(rows(spark, d), laws(spark, d), KEYS, "v", "time", BLOCK)
    return rounded(s.select("venue", "time", F.get("filtered", F.lit(0)).alias("filtered"), F.get("smoothed", F.lit(0)).alias("smoothed"), "mean", "var"), "filtered", "smoothed", "mean", "var", digits=5)


def chain_em_step(spark, d):
    blocks = S.series_blocks(rows(spark, d), KEYS, "v", "time", BLOCK)
    m = S.em_step(blocks, laws(spark, d), KEYS)
    at = lambda c, *i: F.get(c, F.lit(i[0])) if len(i) == 1 else F.get(F.get(c, F.lit(i[0])), F.lit(i[1]))
    return rounded(m.select("venue", at("pi", 0).alias("pi_calm"), at("a", 0, 0).alias("stay_calm"), at("a", 1, 1).alias("stay_wide"), at("mu", 0).alias("mu_calm"), at("mu", 1).alias("mu_wide"), at("sigma", 0).alias("sigma_calm"), at("sigma", 1).alias("sigma_wide"), "ll"), "pi_calm", "stay_calm", "stay_wide", "mu_calm", "mu_wide", "sigma_calm", "sigma_wide", "ll", digits=5)


def chain_fit(spark, d):
    """EM from each venue's law, all venues side by side, every round one pass over all blocks."""
    blocks = S.series_blocks(rows(spark, d), KEYS, "v", "time", BLOCK)
    return S.fit(blocks, laws(spark, d), KEYS, ROUNDS)


def chain_path(spark, d):
    return S.likely_path(rows(spark, d), laws(spark, d), KEYS, "v", "time", BLOCK)


def chain_residuals(spark, d):
    """Moments of the standardised one-step forecast errors, from the second hour on."""
    s = S.chain_states(rows(spark, d), laws(spark, d), KEYS, "v", "time", BLOCK)
    first = s.groupBy("venue").agg(F.min("time").alias("_first"))
    z = s.join(first, "venue").where("time > _first").withColumn("z", (F.col("x") - F.col("mean")) / F.sqrt("var"))
    return rounded(z.groupBy("venue").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.avg(F.col("z") ** 2).alias("square")), "mean", "square", digits=5)


def variance_path(spark, d):
    """The variance of each record's successor under one GARCH law, over all records."""
    r = records(spark, d).select("venue", "event_id", (OMEGA + ALPHA * F.col("premium_bps") ** 2).alias("a"), F.lit(BETA).alias("b"))
    return rounded(S.recurrence(r, KEYS, "event_id", "a", "b", START, "variance"), "variance", digits=5)


def variance_loglik(spark, d):
    """Gaussian log-likelihood of all records under that law: each record with the variance that the records before it give."""
    r = records(spark, d).select("venue", "event_id", "premium_bps", (OMEGA + ALPHA * F.col("premium_bps") ** 2).alias("a"), F.lit(BETA).alias("b"))
    h = S.recurrence(r, KEYS, "event_id", "a", "b", START, "variance")
    both = S.carried(r.join(h, ["venue", "event_id"]), KEYS, "event_id", {"h": F.col("variance")})
    now = F.coalesce("h", F.lit(START))
    term = -0.5 * (F.ln(2 * F.pi() * now) + F.col("premium_bps") ** 2 / now)
    return rounded(both.groupBy("venue").agg(F.count("*").alias("n"), F.sum(term).alias("ll")), "ll", digits=4)


def last_extreme(spark, d):
    """Per record the last one before it and the next one after it with a premium over 40 bps, and the number of such records so far."""
    r = records(spark, d).select("venue", "event_id", "p")
    top = F.when(F.col("p") > 40_000, F.col("event_id"))
    return S.carried(r, KEYS, "event_id", {"last_before": top}, {"next_after": top}, {"so_far": (F.col("p") > 40_000).cast("long")}, size=1000).drop("p")


def sign_segments(spark, d):
    """Unbroken stretches of premiums of one sign: the longest and the number, over all records in order."""
    s = S.segments(records(spark, d).select("venue", "event_id", "p"), KEYS, "event_id", F.col("p") > 0, size=1000)
    runs = s.groupBy("venue", "segment").agg(F.count("*").alias("n"))
    return runs.groupBy("venue").agg(F.count("*").alias("segments"), F.max("n").alias("longest"))


P, Q = STAY
LAW = f"""{REC}, {HOURLY_SQL}, h AS (SELECT venue, time, m / 1000.0::DOUBLE AS x, row_number() OVER (PARTITION BY venue ORDER BY time) AS i, count(*) OVER (PARTITION BY venue) AS n FROM hr),
p AS (SELECT venue, avg(x) AS m1, avg(x) + {SHIFT} * stddev_pop(x) AS m2, {CALM} * stddev_pop(x) AS s1, {WIDE} * stddev_pop(x) AS s2 FROM h GROUP BY 1 HAVING stddev_pop(x) > 0),
e AS (SELECT *, -0.5 * ((x - m1) / s1) ** 2 - ln(s1) - 0.5 * ln(2 * pi()) AS l1, -0.5 * ((x - m2) / s2) ** 2 - ln(s2) - 0.5 * ln(2 * pi()) AS l2, exp(l1) AS b1, exp(l2) AS b2 FROM h JOIN p USING (venue)),
f0 AS (SELECT venue, i, 0.5::DOUBLE AS p1, 0.5 * b1 AS w1, 0.5 * b2 AS w2 FROM e WHERE i = 1),
f AS (SELECT venue, i, p1, w1 / (w1 + w2) AS a1, w2 / (w1 + w2) AS a2, ln(w1 + w2) AS ll FROM f0
UNION ALL SELECT venue, i, p1, w1 / (w1 + w2), w2 / (w1 + w2), ll + ln(w1 + w2) FROM (SELECT f.venue, e.i, f.ll, f.a1 * {P} + f.a2 * (1 - {Q}) AS p1, (f.a1 * {P} + f.a2 * (1 - {Q})) * b1 AS w1, (f.a1 * (1 - {P}) + f.a2 * {Q}) * b2 AS w2 FROM f JOIN e ON e.venue = f.venue AND e.i = f.i + 1) z)"""
BACK = f"""g AS (SELECT venue, i, 1.0::DOUBLE AS g1, 1.0::DOUBLE AS g2 FROM e WHERE i = n
UNION ALL SELECT venue, i, u1 / (u1 + u2), u2 / (u1 + u2) FROM (SELECT g.venue, g.i - 1 AS i, {P} * b1 * g1 + (1 - {P}) * b2 * g2 AS u1, (1 - {Q}) * b1 * g1 + {Q} * b2 * g2 AS u2 FROM g JOIN e ON e.venue = g.venue AND e.i = g.i WHERE g.i > 1) z)"""
SEEN = "s AS (SELECT e.venue, e.time, e.x, e.i, e.n, f.p1, a1, a2, ll, b1, b2, g1, g2, m1, m2, s1, s2, a1 * g1 / (a1 * g1 + a2 * g2) AS c, p1 * m1 + (1 - p1) * m2 AS mean, p1 * (s1 ** 2 + m1 ** 2) + (1 - p1) * (s2 ** 2 + m2 ** 2) AS square FROM e JOIN f ON f.venue = e.venue AND f.i = e.i JOIN g ON g.venue = e.venue AND g.i = e.i)"
R = lambda x, n=5: f"round({x}, {n}) + 0.0"
PAIRS = f"""t AS (SELECT venue, a1 * {P} * nb1 * ng1 / w AS x11, a2 * {Q} * nb2 * ng2 / w AS x22, c FROM (SELECT *, a1 * ({P} * nb1 * ng1 + (1 - {P}) * nb2 * ng2) + a2 * ((1 - {Q}) * nb1 * ng1 + {Q} * nb2 * ng2) AS w FROM (SELECT *, lead(b1) OVER v AS nb1, lead(b2) OVER v AS nb2, lead(g1) OVER v AS ng1, lead(g2) OVER v AS ng2 FROM s WINDOW v AS (PARTITION BY venue ORDER BY i)) x) y WHERE nb1 IS NOT NULL),
tt AS (SELECT venue, sum(x11) / sum(c) AS stay_calm, sum(x22) / sum(1 - c) AS stay_wide FROM t GROUP BY 1),
mm AS (SELECT venue, max(c) FILTER (i = 1) AS pi_calm, sum(c * x) / sum(c) AS mu_calm, sum((1 - c) * x) / sum(1 - c) AS mu_wide, sum(c * x * x) / sum(c) AS q1, sum((1 - c) * x * x) / sum(1 - c) AS q2, arg_max(ll, i) AS ll FROM s GROUP BY 1)"""
VITERBI = f"""v AS (SELECT venue, i, ln(0.5) + l1 AS d1, ln(0.5) + l2 AS d2, 0 AS k1, 0 AS k2 FROM e WHERE i = 1
UNION ALL SELECT v.venue, e.i, greatest(d1 + ln({P}), d2 + ln(1 - {Q})) + l1, greatest(d1 + ln(1 - {P}), d2 + ln({Q})) + l2, CASE WHEN d1 + ln({P}) >= d2 + ln(1 - {Q}) THEN 0 ELSE 1 END, CASE WHEN d1 + ln(1 - {P}) >= d2 + ln({Q}) THEN 0 ELSE 1 END FROM v JOIN e ON e.venue = v.venue AND e.i = v.i + 1),
b AS (SELECT v.venue, v.i, CASE WHEN d1 >= d2 THEN 0 ELSE 1 END AS state FROM v JOIN e ON e.venue = v.venue AND e.i = v.i WHERE v.i = e.n
UNION ALL SELECT b.venue, b.i - 1, CASE b.state WHEN 0 THEN v.k1 ELSE v.k2 END FROM b JOIN v ON v.venue = b.venue AND v.i = b.i WHERE b.i > 1)"""
GARCH = f"""{REC}, x AS (SELECT venue, event_id, premium_bps AS p, {OMEGA} + {ALPHA} * premium_bps ** 2 AS a, row_number() OVER (PARTITION BY venue ORDER BY event_id) AS i FROM fund),
y AS (SELECT venue, i, event_id, p, {START}::DOUBLE AS h, a + {BETA} * {START} AS variance FROM x WHERE i = 1 UNION ALL SELECT x.venue, x.i, x.event_id, x.p, y.variance, x.a + {BETA} * y.variance FROM y JOIN x ON x.venue = y.venue AND x.i = y.i + 1)"""

QUERIES = {
    "chain_loglik": (chain_loglik, f"WITH RECURSIVE {LAW} SELECT venue, {R('arg_max(ll, i)', 6)} AS ll FROM f GROUP BY 1"),
    "chain_states": (chain_states, f"WITH RECURSIVE {LAW}, {BACK}, {SEEN} SELECT venue, time, {R('a1')} AS filtered, {R('c')} AS smoothed, {R('mean')} AS mean, {R('square - mean ** 2')} AS var FROM s"),
    "chain_em_step": (chain_em_step, f"WITH RECURSIVE {LAW}, {BACK}, {SEEN}, {PAIRS} SELECT venue, {R('pi_calm')} AS pi_calm, {R('stay_calm')} AS stay_calm, {R('stay_wide')} AS stay_wide, {R('mu_calm')} AS mu_calm, {R('mu_wide')} AS mu_wide, {R('sqrt(q1 - mu_calm ** 2)')} AS sigma_calm, {R('sqrt(q2 - mu_wide ** 2)')} AS sigma_wide, {R('ll')} AS ll FROM tt JOIN mm USING (venue)"),
    "chain_fit": (chain_fit, None),
    "chain_path": (chain_path, f"WITH RECURSIVE {LAW}, {VITERBI} SELECT b.venue, e.time, CAST(b.state AS INT) AS state FROM b JOIN e ON e.venue = b.venue AND e.i = b.i"),
    "chain_residuals": (chain_residuals, f"WITH RECURSIVE {LAW}, {BACK}, {SEEN}, z AS (SELECT venue, (x - mean) / sqrt(square - mean ** 2) AS z FROM s WHERE i > 1) SELECT venue, count(*) AS n, {R('avg(z)')} AS mean, {R('avg(z * z)')} AS square FROM z GROUP BY 1"),
    "variance_path": (variance_path, f"WITH RECURSIVE {GARCH} SELECT venue, event_id, {R('variance')} AS variance FROM y"),
    "variance_loglik": (variance_loglik, f"WITH RECURSIVE {GARCH} SELECT venue, count(*) AS n, {R('sum(-0.5 * (ln(2 * pi() * h) + p ** 2 / h))', 4)} AS ll FROM y GROUP BY 1"),
    "last_extreme": (last_extreme, f"WITH {REC}, m AS (SELECT venue, event_id, CASE WHEN p > 40000 THEN event_id END AS t FROM fund) SELECT venue, event_id, last_value(t IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_before, first_value(t IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_after, count(t) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM m WINDOW w AS (PARTITION BY venue ORDER BY event_id)"),
    "sign_segments": (sign_segments, f"WITH {REC}, c AS (SELECT venue, event_id, p > 0 AS s, lag(p > 0) OVER (PARTITION BY venue ORDER BY event_id) AS b FROM fund), g AS (SELECT venue, sum(CASE WHEN s IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (PARTITION BY venue ORDER BY event_id) AS g FROM c), n AS (SELECT venue, g, count(*) AS n FROM g GROUP BY 1, 2) SELECT venue, count(*) AS segments, max(n) AS longest FROM n GROUP BY 1"),
}
