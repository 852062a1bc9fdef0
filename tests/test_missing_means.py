"""Blocks in which no record of one's own has a value: their mean is unknown, and they count as SQL counts them."""

import datetime as dt
import random

import pytest

from tidemark.plans import registry
from tests.test_equal_stamps import EVENTS
from tests.test_sql_halves import exact


@pytest.fixture(scope="module")
def missing(spark, tmp_path_factory):
    """Ninety blocks of three venues; click has no value on every fifth day, in every seventh block and in a tenth of the other records."""
    folder, draw, first = tmp_path_factory.mktemp("missing"), random.Random(11), dt.datetime(2024, 1, 1)
    rows = []
    for h in range(8 * 90):
        for v, venue in enumerate(("click", "view", "error")):
            gone = venue == "click" and (h // 24 % 5 == 2 or (h - 1) // 8 % 7 == 3 or draw.random() < 0.1)
            rows.append((len(rows), first + dt.timedelta(hours=h, minutes=7 + v), 1, venue, None if gone else 50 + round(draw.gauss(0, 12), 2), ""))
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def both(spark, folder, name):
    duck = pytest.importorskip("duckdb").connect()
    duck.sql("set timezone = 'UTC'")
    duck.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    mine, theirs = registry.queries()[name](spark, folder).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    for df in (mine, theirs):
        if "block" in df:
            df["block"] = df["block"].astype(str)
    return exact(mine), exact(theirs)


@pytest.mark.parametrize("name", ["block_order", "block_order_summary", "order_levels", "quantile_gap_levels", "quantile_gaps", "shift_levels", "shift_test"])
def test_queries_equal_their_sql_where_means_are_unknown(spark, missing, name):
    mine, theirs = both(spark, missing, name)
    assert mine == theirs


@pytest.mark.parametrize("name", ["order_levels", "quantile_gap_levels", "quantile_gaps", "shift_levels", "shift_test"])
def test_queries_equal_their_sql_where_no_mean_is_known(spark, tmp_path, name):
    first = dt.datetime(2024, 1, 1)
    rows = [(10 * h + v, first + dt.timedelta(hours=h, minutes=7 + v), 1, venue, None if venue == "click" else 30.0 + (7 * h + v) % 41, "") for h in range(48) for v, venue in enumerate(("click", "view"))]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    mine, theirs = both(spark, str(tmp_path), name)
    assert theirs and mine == theirs
