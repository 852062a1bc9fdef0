"""Queries on what is stored already: fingerprints of series, spans that lack stamps, results kept by content."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import scan as S
from tidemark.plans import scans
from tidemark.plans.tables import HOURLY_SQL, RECORDS_SQL as REC, hourly, records, rounded
from tidemark.session import shared_folder
from tidemark.sources import files, store

FIRST, LAST = 1704067200, 1706659200  # seconds of the wanted span: 30 days
HOUR = 3600


def series_fingerprints(spark, d):
    """Per venue: rows, and digests of all its records in whatever order."""
    return store.fingerprints(records(spark, d), ["venue"], ["event_id", "p", "r"])


def uncovered_spans(spark, d):
    """Closed spans of the wanted hours for which a venue has no record."""
    h = hourly(spark, d).select("venue", F.unix_seconds(F.col("time").cast("timestamp")).alias("t"))
    return files.uncovered(h, h, ["venue"], "t", HOUR, FIRST, LAST)


def kept_fits(spark, d):
    """Two-state fits of every venue through a store, asked for twice: the second time none is computed."""
    r = scans.rows(spark, d)
    kept = store.Store(spark, f"{shared_folder(spark)}/fits-{uuid.uuid4().hex[:12]}")
    laws = scans.laws(spark, d)
    compute = lambda new: S.fit(S.series_blocks(new, scans.KEYS, "v", "time", scans.BLOCK), S.same(laws, new.select("venue").distinct(), scans.KEYS, "left_semi"), scans.KEYS, scans.ROUNDS)
    settings = {"states": 2, "rounds": scans.ROUNDS, "law": 1}
    _, first = store.kept(kept, "chain", r, scans.KEYS, ["time", "v"], settings, compute)
    fits, again = store.kept(kept, "chain", r, scans.KEYS, ["time", "v"], settings, compute)
    return rounded(fits.withColumns({"computed": F.lit(first), "computed_again": F.lit(again)}), "ll", digits=4)


DIGEST = lambda extra="": f"sum(CAST(('0x' || left(md5('=' || event_id || '|=' || p || '|=' || r{extra}), 15)) AS HUGEINT))"
QUERIES = {
    "series_fingerprints": (series_fingerprints, f"WITH {REC}, g AS (SELECT venue, CAST(count(*) AS VARCHAR) AS n, CAST({DIGEST()} AS VARCHAR) AS a, CAST({DIGEST(chr(32) + '||' + chr(39) + '|=again' + chr(39))} AS VARCHAR) AS b FROM fund GROUP BY 1) SELECT venue, md5(n || ':' || a || ':' || b) AS fingerprint FROM g"),
    "uncovered_spans": (uncovered_spans, f"""WITH {REC}, {HOURLY_SQL}, h AS (SELECT venue, CAST(epoch(time) AS BIGINT) AS t FROM hr), i AS (SELECT * FROM h WHERE t BETWEEN {FIRST} AND {LAST}), l AS (SELECT venue, t, lag(t) OVER (PARTITION BY venue ORDER BY t) AS b, lead(t) OVER (PARTITION BY venue ORDER BY t) AS n FROM i),
s AS (SELECT venue, coalesce(b + {HOUR}, {FIRST}) AS "start", CASE WHEN b IS NULL THEN t - 1 ELSE t - {HOUR} END AS "end" FROM l UNION ALL SELECT venue, t + {HOUR}, {LAST} FROM l WHERE n IS NULL UNION ALL SELECT DISTINCT venue, {FIRST}, {LAST} FROM h WHERE venue NOT IN (SELECT venue FROM i)) SELECT * FROM s WHERE "start" <= "end" """),
    "kept_fits": (kept_fits, None),
}
