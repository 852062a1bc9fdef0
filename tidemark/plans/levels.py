"""The comparisons between venues at every level at once: named windows, years, half-years, quarters, months and days.

A row is counted once for each window and period that holds it; the operators get level and period
as two more keys, so a document's whole tree comes of one pass per statistic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import funding as X, periods as P
from tidemark.operators import censoring as C, gap as G, islands as I
from tidemark.plans.floors import SPANS
from tidemark.plans.gaps import HOURLY_GAP, ORDER_SQL, STATS, gaps, order_parts
from tidemark.plans.tables import RECORDS_SQL as REC, records, rounded

LEVELS = ("Y", "H", "Q", "M", "D")
PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)
KEYS = ["venue", "level", "period"]


def levelled(rows: DataFrame, time: str, back: int = 1, windows=SPANS) -> DataFrame:
    """Each row once per window and calendar period that holds its stamp, as columns level and period."""
    t = F.col(time)
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")

    def entry(level: str, period: Column, holds: Column | None = None) -> Column:
        e = F.struct(F.lit(level).alias("level"), period.alias("period"))
        return e if holds is None else F.when(holds, e)

    inside = lambda lo, hi, closed: ((t >= stamp(lo)) if closed else (t > stamp(lo))) & (t <= stamp(hi))
    every = [*(entry("window", F.lit(n), inside(lo, hi, c)) for n, lo, hi, c in windows), *(entry(f, P.period(t, f, back)) for f in LEVELS)]
    return rows.select("*", F.inline(F.filter(F.array(*every), lambda e: e.isNotNull())))


def order_levels(spark, d):
    """Counts of blocks by order, their bounds, and the median difference of the known ones."""
    return rounded(G.order_summary(levelled(order_parts(spark, d), "block"), KEYS), "median_diff", "lower", "upper", "share_of_decided", digits=8)


def shift_levels(spark, d):
    """In-band shares after a shift by the median difference of the same window or period."""
    rows = levelled(order_parts(spark, d), "block")
    gap = rows.groupBy(*KEYS).agg(F.median("diff_bps").alias("gap"))
    return rounded(G.shift_test(rows, KEYS, gap), "gap", "own_share", "other_share", "shifted_share", digits=8)


def quantile_gap_levels(spark, d):
    """Plain quantiles of one's own means less the censored ones of the settlements."""
    rows = levelled(order_parts(spark, d), "block")
    one = lambda c, name: C.censored_quantiles(rows, KEYS, c, PROBS).select(*KEYS, "p", F.col("q").alias(name))
    both = one("own_bps", "own_q").join(one("other_bps", "other_q"), [*KEYS, "p"])
    return rounded(both.withColumn("gap", F.col("own_q") - F.col("other_q")), "own_q", "other_q", "gap", digits=8)


def gap_levels(spark, d):
    """Statistics of the matched hourly gap; an hour belongs to the period in which it began."""
    return rounded(G.gap_stats(levelled(gaps(spark, d), "time", 3600), KEYS, "g"), "mean", "q25", "q50", "q75", "share_positive")


def floor_levels(spark, d):
    """Exact counts at the floor, and the censored quartiles of the premium, of every venue and of its records at settlement stamps."""
    r = records(spark, d)
    both = r.unionByName(r.where(X.at_settlement(F.col("ts"))).withColumn("venue", F.concat("venue", F.lit("_8h"))))
    rows = levelled(both.withColumn("seen", X.recovered_premium_bps(F.col("rate"))), "ts")
    counts = C.floor_counts(rows, KEYS, F.col("rate"), X.literal(X.FLOOR_8H)).select(*KEYS, "n", "below", "at", "above")
    q = C.wide_quantiles(C.censored_quantiles(rows, KEYS, "seen"), KEYS)
    return rounded(counts.join(q, KEYS), "p25", "p50", "p75", digits=5)


def ranking(spark, d):
    """How one venue's daily share at the floor stands against the others': days by rank, its smallest and largest share, and from when on it is never between."""
    rows = records(spark, d).withColumn("period", P.period(F.col("ts"), "D"))
    shares = C.floor_counts(rows, ["period", "venue"], F.col("rate"), X.literal(X.FLOOR_8H)).select("period", "venue", F.col("share_at").alias("share"))
    r = C.rank_against(shares, ["period"], "click").where("rank is not null")
    n = lambda k: F.count_if(F.col("rank") == k).alias(k)
    facts = r.groupBy(F.lit("click").alias("venue")).agg(F.min("period").alias("first"), F.max("period").alias("last"), F.count("*").alias("n"), n("above_all"), n("between"), n("below_all"), F.min_by("period", F.struct("mine", "period")).alias("lowest_on"), F.min("mine").alias("lowest_share"), F.min_by("period", F.struct(-F.col("mine"), F.col("period"))).alias("highest_on"), F.max("mine").alias("highest_share"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rank") == "below_all", F.col("period")))), " ").alias("days_below"))
    run = I.last_run_start(r.select(F.lit("click").alias("venue"), "period", F.when(F.col("rank") == "between", "between").otherwise("out").alias("rank")), ["venue"], value="out").select("venue", F.col("run_start").alias("out_since"))
    return rounded(facts.join(run, "venue"), "lowest_share", "highest_share", digits=9)


def partial_periods(spark, d):
    """Whether the first and last period of each calendar level are covered only in part by the records' span."""
    ends = records(spark, d).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    rows = ends.select(F.inline(F.array(*(F.struct(F.lit(f).alias("level"), F.lit(side).alias("side"), P.period(F.col(c), f).alias("period"), *(x.alias(n) for n, x in zip(("start", "stop"), P.period_bounds(F.col(c), f))), F.col("a"), F.col("b")) for f in LEVELS[:4] for side, c in (("first", "a"), ("last", "b"))))))
    return rows.select("level", "side", "period", F.when(F.col("side") == "first", F.col("a") > F.col("start")).otherwise(F.col("b") < F.col("stop")).alias("partial"))


def level_sql(table: str, time: str, back: str) -> str:
    """A table ``lv``: each row of ``table`` once per window and period."""
    t = f"({time} - INTERVAL {back})"
    windows = [f"CASE WHEN {time} {'>=' if c else '>'} TIMESTAMP '{lo}' AND {time} <= TIMESTAMP '{hi}' THEN {{'level': 'window', 'period': '{n}'}} END" for n, lo, hi, c in SPANS]
    calendar = {"Y": f"CAST(year({t}) AS VARCHAR)", "H": f"year({t}) || CASE WHEN month({t}) <= 6 THEN 'H1' ELSE 'H2' END", "Q": f"year({t}) || 'Q' || quarter({t})", "M": f"strftime({t}, '%Y-%m')", "D": f"strftime({t}, '%Y-%m-%d')"}
    every = ", ".join([*windows, *(f"{{'level': '{k}', 'period': {e}}}" for k, e in calendar.items())])
    return f"lv AS (SELECT * EXCLUDE (e), e.level AS level, e.period AS period FROM (SELECT *, unnest(list_filter([{every}], lambda x: x IS NOT NULL)) AS e FROM {table}))"


def censored_sql(value: str, probs, out: str) -> str:
    """Censored quantiles of ``value`` by venue, level, period and p, as a table ``out``."""
    return f"""{out}0 AS (SELECT venue, level, period, {value} AS v, row_number() OVER (w ORDER BY coalesce({value}, 1.0), {value} IS NULL) - 1 AS i, count(*) OVER w AS n FROM lv WINDOW w AS (PARTITION BY venue, level, period)),
{out}1 AS (SELECT *, (n - 1) * p AS h, floor((n - 1) * p + 1e-12) AS lo, ceil((n - 1) * p - 1e-12) AS hi FROM (SELECT *, unnest({list(probs)}::DOUBLE[]) AS p FROM {out}0) z),
{out} AS (SELECT venue, level, period, p, CASE WHEN count(*) FILTER (i IN (lo, hi) AND v IS NULL) = 0 THEN max(v) FILTER (i = lo) + (max(v) FILTER (i = hi) - max(v) FILTER (i = lo)) * (max(h) - max(lo)) END AS q FROM {out}1 GROUP BY 1, 2, 3, 4)"""


ORDERED = f"{ORDER_SQL}, {level_sql('k', 'block', '1 SECOND')}"
SEEN = f"WITH {REC}, b AS (SELECT venue, ts, r FROM fund UNION ALL SELECT venue || '_8h', ts, r FROM fund WHERE hour(ts) IN (0, 8, 16) AND minute(ts) = 0), s AS (SELECT *, CASE WHEN r < 1000 THEN (r - 5000) / 1000.0::DOUBLE WHEN r > 1000 THEN (r + 5000) / 1000.0::DOUBLE END AS seen FROM b), {level_sql('s', 'ts', '1 SECOND')}"
R = lambda x, n=8: f"round({x}, {n}) + 0.0"
RANKS = f"""WITH {REC}, s AS (SELECT strftime(ts - INTERVAL 1 SECOND, '%Y-%m-%d') AS period, venue, avg(CASE WHEN r = 1000 THEN 1.0 ELSE 0.0 END) AS share FROM fund GROUP BY 1, 2),
g AS (SELECT period, max(share) FILTER (venue = 'click') AS mine, min(share) FILTER (venue <> 'click') AS lo, max(share) FILTER (venue <> 'click') AS hi FROM s GROUP BY 1), k AS (SELECT *, CASE WHEN mine > hi THEN 'above_all' WHEN mine < lo THEN 'below_all' ELSE 'between' END AS rank FROM g WHERE mine IS NOT NULL AND lo IS NOT NULL)"""
BOUNDS = {"Y": "date_trunc('year', {t})", "H": "make_date(year({t}), CASE WHEN month({t}) <= 6 THEN 1 ELSE 7 END, 1)", "Q": "date_trunc('quarter', {t})", "M": "date_trunc('month', {t})"}
LONG = {"Y": "1 YEAR", "H": "6 MONTH", "Q": "3 MONTH", "M": "1 MONTH"}
NAMES = {"Y": "CAST(year({t}) AS VARCHAR)", "H": "year({t}) || CASE WHEN month({t}) <= 6 THEN 'H1' ELSE 'H2' END", "Q": "year({t}) || 'Q' || quarter({t})", "M": "strftime({t}, '%Y-%m')"}

QUERIES = {
    "order_levels": (order_levels, f"{ORDERED}, g AS (SELECT venue, level, period, count(*) AS n, count(*) FILTER (ord = 'above') AS above, count(*) FILTER (ord = 'below') AS below, count(*) FILTER (ord = 'undecided') AS undecided, median(diff) AS md FROM lv GROUP BY 1, 2, 3) SELECT venue, level, period, n, above, below, undecided, {R('md')} AS median_diff, {R('above / n')} AS lower, {R('(above + undecided) / n')} AS upper, {R('above / nullif(above + below, 0)')} AS share_of_decided FROM g"),
    "shift_levels": (shift_levels, f"{ORDERED}, m AS (SELECT venue, level, period, median(diff) AS gap FROM lv GROUP BY 1, 2, 3) SELECT venue, level, period, {R('any_value(gap)')} AS gap, {R('avg(CASE WHEN own BETWEEN -4 AND 6 THEN 1.0 ELSE 0.0 END)')} AS own_share, {R('avg(CASE WHEN other IS NULL THEN 1.0 ELSE 0.0 END)')} AS other_share, {R('avg(CASE WHEN own - gap BETWEEN -4 AND 6 THEN 1.0 WHEN own - gap IS NULL THEN NULL ELSE 0.0 END)')} AS shifted_share FROM lv JOIN m USING (venue, level, period) GROUP BY 1, 2, 3"),
    "quantile_gap_levels": (quantile_gap_levels, f"{ORDERED}, {censored_sql('own', PROBS, 'a')}, {censored_sql('other', PROBS, 'b')} SELECT venue, level, period, p, {R('a.q')} AS own_q, {R('b.q')} AS other_q, {R('a.q - b.q')} AS gap FROM a JOIN b USING (venue, level, period, p)"),
    "gap_levels": (gap_levels, f"{HOURLY_GAP}, {level_sql('gp', 'time', '1 HOUR')} SELECT venue, level, period, {STATS.format(c='g')} FROM lv GROUP BY 1, 2, 3"),
    "floor_levels": (floor_levels, f'''{SEEN}, {censored_sql('seen', (0.25, 0.5, 0.75), 'q')}, c AS (SELECT venue, level, period, count(*) AS n, count(*) FILTER (r < 1000) AS below, count(*) FILTER (r = 1000) AS "at", count(*) FILTER (r > 1000) AS above FROM lv GROUP BY 1, 2, 3) SELECT venue, level, period, c.n, below, "at", above, {R("max(q.q) FILTER (p = 0.25)", 5)} AS p25, {R("max(q.q) FILTER (p = 0.5)", 5)} AS p50, {R("max(q.q) FILTER (p = 0.75)", 5)} AS p75 FROM c JOIN q USING (venue, level, period) GROUP BY ALL'''),
    "ranking": (ranking, f"""{RANKS}, o AS (SELECT max(period) FILTER (rank = 'between') AS broken FROM k) SELECT 'click' AS venue, min(period) AS first, max(period) AS last, count(*) AS n, count(*) FILTER (rank = 'above_all') AS above_all, count(*) FILTER (rank = 'between') AS "between", count(*) FILTER (rank = 'below_all') AS below_all, arg_min(period, (mine, period)) AS lowest_on, {R('min(mine)', 9)} AS lowest_share, arg_min(period, (-mine, period)) AS highest_on, {R('max(mine)', 9)} AS highest_share, coalesce(string_agg(period, ' ' ORDER BY period) FILTER (rank = 'below_all'), '') AS days_below, min(period) FILTER (broken IS NULL OR period > broken) AS out_since FROM k, o"""),
    "partial_periods": (partial_periods, f"WITH {REC}, x AS (SELECT min(ts) AS a, max(ts) AS b FROM fund), t AS (SELECT a, b, a - INTERVAL 1 SECOND AS ta, b - INTERVAL 1 SECOND AS tb FROM x) " + " UNION ALL ".join(f"SELECT '{f}' AS level, '{s}' AS side, {NAMES[f].format(t=t)} AS period, {('a > ' + BOUNDS[f].format(t=t)) if s == 'first' else ('b < ' + BOUNDS[f].format(t=t) + ' + INTERVAL ' + LONG[f])} AS partial FROM t" for f in LEVELS[:4] for s, t in (("first", "ta"), ("last", "tb")))),
}
