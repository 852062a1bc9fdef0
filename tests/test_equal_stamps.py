"""Records of one venue with equal stamps and different values: the first in the table counts as the block's last settlement, as in SQL read in order."""

import datetime as dt
import random

import pytest

from tidemark.plans import registry
from tests.test_sql_halves import exact

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def equal(spark, tmp_path_factory):
    """Ninety blocks of three venues, the block's last stamp standing six times with other values; some values are missing."""
    folder, draw, first = tmp_path_factory.mktemp("equal"), random.Random(7), dt.datetime(2024, 1, 1)
    rows = []
    for b in range(90):
        for v, venue in enumerate(("click", "view", "error")):
            for h in (0, 3, 5, 7, 7, 7, 7, 7, 7):
                value = None if venue != "click" and draw.random() < 0.2 else 50 + round(draw.gauss(0, 60), 2)
                rows.append((len(rows), first + dt.timedelta(hours=8 * b + h, minutes=7 + v), 1, venue, value, ""))
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["block_order", "block_order_summary", "fit_errors", "order_levels", "quantile_gap_levels", "quantile_gaps", "shift_levels", "shift_test"])
def test_queries_equal_their_sql_on_equal_stamps(spark, equal, name):
    duck = pytest.importorskip("duckdb").connect()
    duck.sql("set timezone = 'UTC'")
    duck.sql("set threads = 1")  # else SQL's own choice changes from run to run
    duck.sql(f"create view events as select * from '{equal}/events.parquet/*.parquet'")
    mine, theirs = registry.queries()[name](spark, equal).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    for df in (mine, theirs):
        if "block" in df:
            df["block"] = df["block"].astype(str)
    assert exact(mine) == exact(theirs)
