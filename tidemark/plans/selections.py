"""Queries on exact quantiles, ranks and resampled medians, found by counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import selection as S
from tidemark.plans.tables import HOURLY_SQL, RECORDS_SQL as REC, hourly, records, rounded

PROBS = (0.0005, 0.01, 0.25, 0.5, 0.75, 0.99, 0.9995)
REPS, BLOCK, SEED = 500, 24, 7
KEYS = ["venue"]


def record_quantiles(spark, d):
    q = S.quantiles(records(spark, d), KEYS, "premium_bps", PROBS)
    return rounded(q.select("venue", "n", F.posexplode("q").alias("i", "q")), "q")


def rank_correlations(spark, d):
    """Pearson and Spearman of each record's premium with its hour's mean premium, over all records."""
    r, h = records(spark, d), hourly(spark, d)
    return rounded(S.correlations(r.join(h, ["venue", "time"]), KEYS, "p", "m"), "pearson", "spearman", digits=8)


def premium_ranks(spark, d):
    return S.value_ranks(records(spark, d), KEYS, "p").select("venue", F.col("v").cast("long").alias("p"), "c", "rank")


def bootstrap_counts(spark, d):
    h = hourly(spark, d).withColumn("v", F.col("m") / 1000.0)
    return rounded(S.bootstrap_interval(h, KEYS, "v", "time", BLOCK, REPS, seed=SEED), "median", "lo", "hi")


DRAW = f"CAST(('0x' || left(md5('{SEED}:' || r || ':' || j), 8)) AS BIGINT)"
QUERIES = {
    "record_quantiles": (record_quantiles, f"WITH {REC}, q AS (SELECT venue, count(*) AS n, quantile_cont(premium_bps, {list(PROBS)}) AS q FROM fund GROUP BY 1) SELECT venue, n, CAST(i AS INT) AS i, round(q[i + 1], 6) + 0.0 AS q FROM q, range({len(PROBS)}) t(i)"),
    "rank_correlations": (rank_correlations, f"""WITH {REC}, {HOURLY_SQL}, j AS (SELECT venue, p, m FROM fund JOIN hr USING (venue, time)), r AS (SELECT *, rank() OVER (PARTITION BY venue ORDER BY p) + (count(*) OVER (PARTITION BY venue, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY venue ORDER BY m) + (count(*) OVER (PARTITION BY venue, m) - 1) / 2.0 AS b FROM j)
SELECT venue, count(*) AS n, round(corr(p, m), 8) + 0.0 AS pearson, round(corr(a, b), 8) + 0.0 AS spearman FROM r GROUP BY 1"""),
    "premium_ranks": (premium_ranks, f"WITH {REC}, r AS (SELECT venue, p, rank() OVER (PARTITION BY venue ORDER BY p) AS k FROM fund) SELECT venue, p, count(*) AS c, CAST(any_value(k) + (count(*) - 1) / 2.0 AS DOUBLE) AS rank FROM r GROUP BY 1, 2"),
    "bootstrap_counts": (bootstrap_counts, f"""WITH {REC}, {HOURLY_SQL}, h AS (SELECT venue, m / 1000.0::DOUBLE AS v, row_number() OVER (PARTITION BY venue ORDER BY time) - 1 AS i FROM hr), n AS (SELECT venue, count(*) AS n, least({BLOCK}, count(*)) AS w, median(v) AS median FROM h GROUP BY 1),
d AS (SELECT venue, r, j, w, n, {DRAW} % (n - w + 1) AS s FROM (SELECT *, unnest(range(0, CAST(ceil(n / w) AS BIGINT))) AS j FROM n) x, range({REPS}) t(r)),
m AS (SELECT d.venue, d.r, median(h.v) AS x FROM d JOIN h ON h.venue = d.venue AND h.i >= d.s AND h.i < d.s + least(d.w, d.n - d.j * d.w) GROUP BY 1, 2)
SELECT n.venue, n.n, round(n.median, 6) + 0.0 AS median, round(quantile_cont(x, 0.025), 6) + 0.0 AS lo, round(quantile_cont(x, 0.975), 6) + 0.0 AS hi FROM n JOIN m USING (venue) GROUP BY 1, 2, n.median"""),
}
