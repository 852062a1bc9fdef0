"""Blocks (t - 8 h, t] end to the microsecond, in queries as in their SQL."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import periods as P
from tidemark.plans import registry
from tests.test_oracle import plain


def test_a_fraction_past_an_end_belongs_to_the_next_block(spark):
    end = dt.datetime(2024, 1, 2, 8)
    at = {end: end, end + dt.timedelta(microseconds=1): end + dt.timedelta(hours=8), end + dt.timedelta(microseconds=999_999): end + dt.timedelta(hours=8), end - dt.timedelta(microseconds=1): end}
    at |= {dt.datetime(1969, 12, 31, 16, 0, 0, 1): dt.datetime(1970, 1, 1), dt.datetime(9999, 12, 31, 15, 59, 59, 999_999): dt.datetime(9999, 12, 31, 16)}
    rows = spark.createDataFrame([(t,) for t in at], "t timestamp_ntz")
    assert dict(rows.select("t", P.block_end(F.col("t"))).collect()) == at


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """Six blocks of three venues, the last always in the band, with records a fraction of a second past each end."""
    folder = tmp_path_factory.mktemp("edges")
    rows, first = [], dt.datetime(2024, 1, 1)
    for b in range(6):
        for v, venue in enumerate(("click", "view", "error")):
            for h in range(8):
                rows.append((len(rows), first + dt.timedelta(hours=8 * b + h, minutes=7 + v), 1, venue, 40.0 + 3 * ((5 * b + 3 * h) % 9) if venue == "error" else 3.0 + 17 * ((5 * b + 3 * h + v) % 9), ""))
            rows.append((len(rows), first + dt.timedelta(hours=8 * b, microseconds=300_000 + v), 1, venue, 45.0 if venue == "error" else 5.0 + 31 * b, ""))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["block_order", "block_order_summary", "fit_errors", "order_levels", "quantile_gap_levels", "quantile_gaps", "shift_levels", "shift_test"])
def test_queries_on_blocks_match_their_sql(spark, edges, name):
    duck = pytest.importorskip("duckdb").connect()
    duck.sql("set timezone = 'UTC'")
    duck.sql(f"create view events as select * from '{edges}/events.parquet/*.parquet'")
    mine = registry.queries()[name](spark, edges).toPandas()
    assert plain(mine) == plain(duck.sql(registry.oracle_sql()[name]).df())
