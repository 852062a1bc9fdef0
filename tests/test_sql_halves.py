"""Halves of the last digit and the interpolation of quantiles come out as in SQL, to the last bit."""

import datetime as dt
import random

import pandas as pd
import pytest

from tidemark.operators import censoring as C
from tidemark.plans import registry
from tidemark.plans.tables import rounded


@pytest.fixture(scope="module")
def duck():
    c = pytest.importorskip("duckdb").connect()
    c.sql("set timezone = 'UTC'")
    return c


def exact(df):
    return sorted((tuple("null" if pd.isna(v) else v if isinstance(v, str) else float(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("digits", [5, 8])
def test_halves_are_rounded_as_sql_does(spark, duck, digits):
    rows = pd.DataFrame({"id": range(4000)}).assign(x=lambda r: (r["id"] * 10 - 19995) / 10 ** (digits + 1))
    duck.register("halves", rows)
    theirs = duck.sql(f"SELECT id, round(x, {digits}) + 0.0 AS x FROM halves").df()
    assert exact(rounded(spark.createDataFrame(rows), "x", digits=digits).toPandas()) == exact(theirs)


def test_plain_quantiles_equal_quantile_cont(spark, duck):
    draw, probs = random.Random(5), (0.1, 0.25, 0.5, 0.75, 0.9)
    rows = pd.DataFrame([(k, draw.randint(-300, 300) / draw.choice((7000, 8000))) for k in range(40) for _ in range(3 + 5 * k)], columns=["k", "v"])
    duck.register("drawn", rows)
    theirs = duck.sql(" UNION ALL ".join(f"SELECT k, {p}::DOUBLE AS p, quantile_cont(v, {p}) AS q FROM drawn GROUP BY k" for p in probs)).df()
    assert exact(C.censored_quantiles(spark.createDataFrame(rows), ["k"], "v", probs, plain=True).drop("n").toPandas()) == exact(theirs)


def test_plain_quantiles_leave_nulls_out(spark):
    rows = spark.createDataFrame([("a", None), ("a", 1.0), ("a", 2.0), ("b", None)], "k string, v double")
    assert [(r.k, r.q, r.n) for r in C.censored_quantiles(rows, ["k"], "v", (0.5,), plain=True).collect()] == [("a", 1.5, 2)]


@pytest.fixture(scope="module")
def months(spark, tmp_path_factory):
    """Blocks of eight hours of five venues, one record an hour, drawn by a fixed seed."""
    folder, draw, first = tmp_path_factory.mktemp("months"), random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(0, first + dt.timedelta(hours=h, minutes=7 + v), 1, venue, 50 + round(draw.gauss(0, 60), 2), "") for h in range(8 * 96) for v, venue in enumerate(("click", "view", "error", "signup", "purchase"))]
    spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_fit_errors_rounds_its_shares_as_sql_does(spark, duck, tmp_path):
    """Of 320 blocks k end within the distance: k / 320 is a half of the fifth digit for odd k."""
    first, rows = dt.datetime(2024, 1, 1), []
    for k in (23, 41, 51):
        for b in range(320):
            end = first + dt.timedelta(hours=8 * b)
            rows += [(len(rows), end - dt.timedelta(hours=1), 1, f"v{k}", 250.0 if b < k else 850.0, ""), (len(rows) + 1, end, 1, f"v{k}", 250.0, "")]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck.sql(f"create or replace view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    mine = registry.queries()["fit_errors"](spark, str(tmp_path)).toPandas()
    assert sorted(mine["off_floor"].unique()) == [320]
    assert exact(mine) == exact(duck.sql(registry.oracle_sql()["fit_errors"]).df())


@pytest.mark.parametrize("name", ["quantile_gaps"])
def test_queries_equal_their_sql_to_the_last_digit(spark, duck, months, name):
    duck.sql(f"create or replace view events as select * from '{months}/events.parquet/*.parquet'")
    assert exact(registry.queries()[name](spark, months).toPandas()) == exact(duck.sql(registry.oracle_sql()[name]).df())
