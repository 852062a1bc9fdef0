"""Readers, the paged data source on recorded answers, and archive frames."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.periods import parse_day, parse_stamp
from tidemark.sources import archive, artifacts, files, rest


def record(folder, page, start, end, answer):
    (folder / rest.request_name(*rest.request_of(page, start, end))).write_text(json.dumps(answer))


def test_forward_pages_become_partitions(spark, tmp_path):
    step = rest.SERIES["binance_premium_1h"]["step"]
    start, end = 0, step * 1999
    pages = rest.pages("binance_premium_1h", "BTCUSDT", start, end)
    assert len(pages) == 2
    for p in pages:
        record(tmp_path, p, p.start, p.end, [[t, "0", "0", "0", f"{t // step}e-6"] for t in range(-(-p.start // step) * step, p.end + 1, step)])
    rest.register(spark)
    rows = spark.read.format("funding_series").options(series="binance_premium_1h", symbols="BTCUSDT", start=str(start), end=str(end), replay=str(tmp_path)).load()
    assert rows.count() == 2000 and rows.select("time_ms").distinct().count() == 2000


def test_series_without_rows_are_named(spark, tmp_path):
    step = rest.SERIES["binance_premium_1h"]["step"]
    for symbol, n in (("BTCUSDT", 5), ("ETHUSDT", 0)):
        for p in rest.pages("binance_premium_1h", symbol, 0, 4 * step):
            record(tmp_path, p, p.start, p.end, [[t * step, "0", "0", "0", "1e-6"] for t in range(n)])
    wanted = {"start": 0, "end": 4 * step, "replay": str(tmp_path)}
    assert rest.fetched(spark, [("binance_premium_1h", "BTCUSDT")], **wanted).count() == 5
    with pytest.raises(ValueError, match="ETHUSDT"):
        rest.fetched(spark, [("binance_premium_1h", "BTCUSDT, ETHUSDT")], **wanted)


def test_backward_cursor_stops_and_keeps_each_stamp_once(tmp_path):
    step, n = rest.SERIES["bybit_funding"]["step"], 250
    page = rest.pages("bybit_funding", "BTCUSDT", 0, step * (n - 1))[0]
    answer = lambda lo, hi: {"retCode": 0, "result": {"list": [{"fundingRateTimestamp": str(t), "fundingRate": "0.0001"} for t in range(hi // step * step, -1, -step)][:200]}}
    record(tmp_path, page, 0, page.end, answer(0, page.end))
    oldest = (n - 200) * step
    record(tmp_path, page, 0, oldest - 1, answer(0, oldest - 1))
    rows = list(rest.rows_of(page, replay=str(tmp_path)))
    assert len(rows) == n and len({r[2] for r in rows}) == n


def test_bad_answer_is_an_error(tmp_path):
    page = rest.pages("bybit_funding", "X", 0, 10)[0]
    record(tmp_path, page, 0, 10, {"retCode": 10001, "retMsg": "no"})
    with pytest.raises(ValueError, match="no"):
        list(rest.rows_of(page, replay=str(tmp_path)))


def test_frames(spark, tmp_path):
    text = "Time,Coin,Funding_Rate,premium,Mark Px\n" + "".join(f"2024-01-01T0{h}:00:00Z,BTC,0.0000125,0.0001,{100 + h}\n1704067200,eth,0,0,1\n" for h in range(3))
    (tmp_path / "20240101.csv.lz4").write_bytes(archive.framed(text.encode(), 50))
    got = archive.read_frames(spark, str(tmp_path), "btc").orderBy("time").collect()
    assert len(got) == 3 and got[2].mark_px == 102.0 and got[0].funding == 0.0000125
    with pytest.raises(ValueError):
        archive.unframed(archive.framed(b"x")[:6] + b"\0" + archive.framed(b"x")[7:])


def test_compressed_block():
    out = bytearray()
    archive.block(bytes([0x34]) + b"abc" + b"\x03\x00" + bytes([0x10]) + b"z", out)
    assert bytes(out) == b"abcabcabcabz"[: len(out) - 1] + b"z"


def test_stamps_and_days(spark):
    rows = spark.createDataFrame([("1704067200",), ("1704067200000",), ("2024-01-01T00:00:00Z",), ("2024-01-01 00:00:00",), ("x",)], "s string")
    assert len({r[0] for r in rows.limit(4).select(parse_stamp(F.col("s"))).collect()}) == 1
    assert rows.where("s = 'x'").select(parse_stamp(F.col("s"))).first()[0] is None
    days = spark.createDataFrame([("2024-01-31",), ("20240131",), ("2024/01/31",), ("31.01.2024",), ("31-01",)], "s string").select(parse_day(F.col("s"))).collect()
    assert len({r[0] for r in days[:4]}) == 1 and days[4][0] is None


def test_day_keys(spark):
    keys = archive.day_keys(spark, "2024-02-28", "2024-03-01")
    assert [r.key for r in keys.orderBy("day").collect()] == ["asset_ctxs/20240228.csv.lz4", "asset_ctxs/20240229.csv.lz4", "asset_ctxs/20240301.csv.lz4"]
    assert keys.where(archive.key_day(F.col("key")) != F.col("day")).count() == 0
    assert [str(r.day) for r in archive.sample_days(spark, "2024-01-15", "2024-03-20").orderBy("day").collect()] == ["2024-02-01", "2024-03-01"]


def test_resolved_names(spark):
    rows = spark.createDataFrame([("1", "BTC", "0.1", "0.2")], "TIMESTAMP string, Coin string, funding_rate string, Premium string")
    assert files.resolved(rows).columns == ["time", "coin", "funding", "premium"]
    with pytest.raises(ValueError, match="premium"):
        files.resolved(rows.drop("Premium"))


def test_panel_checks(spark, tmp_path):
    good = spark.sql("select timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, id) as time, 1.0D o, 1.0D h, 1.0D l, 1.0D c from range(5) t(id)".replace("make_dt_interval(0, id)", "make_dt_interval(0, cast(id as int))"))
    good.write.parquet(str(tmp_path / "a.parquet"))
    assert files.panel(spark, str(tmp_path / "a.parquet")).count() == 5
    good.unionByName(good).write.parquet(str(tmp_path / "b.parquet"))
    with pytest.raises(ValueError, match="repeated"):
        files.panel(spark, str(tmp_path / "b.parquet"))


def test_csv_round_trip_counts(spark, tmp_path):
    rows = spark.range(7).select(F.col("id").alias("open_ms"), *(F.lit("0.1").alias(c) for c in ("open", "high", "low", "close", "n")))
    assert files.write_csv(rows, str(tmp_path / "m"), "gzip") == 7
    assert files.csv(spark, str(tmp_path / "m"), files.MINUTES).count() == 7


def test_artifacts(spark):
    rows = spark.createDataFrame([("a", 1, float("nan")), ("b", 2, 0.5)], "k string, n int, v double")
    doc = json.loads(artifacts.payload({"part": (rows, ["k"])}))
    assert doc["part"]["a"] == {"n": 1, "v": None}
    assert ("/part/b/v", "0.5") in artifacts.flattened(doc)
    assert r"b & 2 & 0.50 \\" in artifacts.latex(rows, ["k", "n", "v"])
    assert artifacts.sheet(rows, ["k", "v"]).splitlines()[0].startswith("k")
