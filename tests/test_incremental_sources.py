"""Archive objects cut into spans, holes of a cache, one pace for many tasks, and a stream that goes on where it stopped."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.sources import archive, files, rest

MINUTE = 60_000


def record(folder, page, start, end, answer):
    folder.mkdir(exist_ok=True)
    (folder / rest.request_name(*rest.request_of(page, start, end))).write_text(json.dumps(answer))


def context_text(names, rows):
    return "\n".join([",".join(names), *(",".join(map(str, r)) for r in rows)])


def test_each_object_has_its_own_header(spark, tmp_path):
    one = context_text(["Time", "Coin", "Funding_Rate", "premium", "Mark Px"], [("2024-01-01T00:00:00Z", "BTC", 0.1, 0.2, 100), ("2024-01-01T01:00:00Z", "eth", 9, 9, 9)])
    two = context_text(["premium", "coin", "extra", "timestamp", "funding"], [(0.4, "BTC", '"a,b"', 1704153600, 0.3)])
    (tmp_path / "20240101.csv.lz4").write_bytes(archive.framed(one.encode(), 11))
    (tmp_path / "20240102.csv.lz4").write_bytes(pa.compress(two.encode(), codec="lz4", asbytes=True))
    (tmp_path / "20240103.csv.lz4").write_bytes(archive.framed(b""))
    got = archive.read_frames(spark, str(tmp_path), "btc").orderBy("time").collect()
    assert [(str(r.time), r.funding, r.premium, r.mark_px) for r in got] == [("2024-01-01 00:00:00", 0.1, 0.2, 100.0), ("2024-01-02 00:00:00", 0.3, 0.4, None)]
    (tmp_path / "20240104.csv.lz4").write_bytes(archive.framed(b"time,coin,funding\n1,BTC,2\n"))
    with pytest.raises(Exception, match="20240104.*columns missing: premium"):
        archive.read_frames(spark, str(tmp_path), "btc").count()


@pytest.mark.parametrize("span_bytes", [1, 40, 1000, 10**9])
def test_spans_of_an_object_lose_and_repeat_no_line(tmp_path, span_bytes):
    rnd = random.Random(span_bytes)
    for end in ("", "\n", "\n\n"):
        lines = ["time,coin,funding,premium"] + [f"{i},BTC,{'7' * rnd.choice([1, 3, 90])},0" for i in range(300)]
        path = tmp_path / "x.lz4"
        path.write_bytes(archive.framed(("\n".join(lines) + end).encode(), rnd.choice([7, 64, 333])))
        with archive.opened(f"file://{path}") as file:
            begin, independent, _ = archive.frame_head(file)
            cuts = [begin]
            for at, size, _ in archive.block_sizes(file):
                if at + size - cuts[-1] > span_bytes and at > cuts[-1]:
                    cuts.append(at)
            got = [x.decode() for a, b in zip(cuts, [*cuts[1:], 2**62]) for x in archive.lines_of(file, a, b, independent)]
        assert [x for x in got if x] == lines
        assert span_bytes > 1000 or len(cuts) > 3


def test_blocks_that_look_back_are_one_span(spark, tmp_path):
    rows = [(1704067200 + 3600 * i, "BTC", f"0.{i}", "0.1") for i in range(20_000)]
    (tmp_path / "a.lz4").write_bytes(pa.compress(context_text(["time", "coin", "funding", "premium"], rows).encode(), codec="lz4", asbytes=True))
    (tmp_path / "b.lz4").write_bytes(archive.framed(context_text(["coin", "time", "premium", "funding"], [(c, t, p, f) for t, c, f, p in rows]).encode(), 5000))
    objects = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    n = {r.path[-5:]: r["count"] for r in archive.spans(objects, 20_000).groupBy("path").count().collect()}
    assert n["a.lz4"] == 1 or n["a.lz4"] > 1 and archive.frame_head(archive.opened(f"file://{tmp_path}/a.lz4"))[1]
    assert n["b.lz4"] > 10
    got = archive.read_frames(spark, str(tmp_path), "BTC", 20_000)
    assert got.count() == 40_000 and got.distinct().count() == 20_000


def test_holes_and_what_is_not_stored(spark):
    stamps = {"a": [3, 4, 5, 9, 10, 20], "b": [], "c": list(range(31)), None: [0, 30, 99], "d": [-5, 40]}
    stored = spark.createDataFrame([(k, t) for k, ts in stamps.items() for t in ts * 2], "k string, t long")
    wanted = spark.createDataFrame([(k,) for k in stamps], "k string")
    got = {}
    for r in files.uncovered(stored, wanted, ["k"], "t", 1, 0, 30).collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    want = {}
    for k, ts in stamps.items():
        lack = [t for t in range(31) if t not in ts]
        for t in lack:
            runs = want.setdefault(k, [])
            if runs and runs[-1][1] == t - 1:
                runs[-1] = (runs[-1][0], t)
            else:
                runs.append((t, t))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_a_cache_with_a_hole_does_not_cover(spark):
    start = 1704067200_000
    rows = lambda minutes: spark.createDataFrame([(start + MINUTE * m,) for m in minutes], "open_ms long")
    span = ("2024-01-01 00:00:00", "2024-01-01 01:00:00")
    assert files.covers(rows(range(60)), *span) and files.covers(rows(range(-5, 80)), *span)
    assert not files.covers(rows([m for m in range(60) if m != 30]), *span)
    assert not files.covers(rows(range(59)), *span) and not files.covers(rows([]), *span)


def test_only_holes_are_asked_for(spark, tmp_path):
    series, step = "binance_premium_1h", rest.SERIES["binance_premium_1h"]["step"]
    old = [(series, "BTC", t * step, "old", None) for t in [*range(3, 10), *range(14, 20)]]
    stored = spark.createDataFrame(old, rest.SCHEMA)
    answers = {"BTC": [(0, 3 * step - 1), (10 * step, 13 * step), (20 * step, 24 * step)], "ETH": [(0, 24 * step)]}
    for symbol, asked in answers.items():  # answers for these spans only: any other request would fail
        for a, b in asked:
            (page,) = rest.pages(series, symbol, a, b)
            record(tmp_path / "r", page, a, b, [[t, "0", "0", "0", "new"] for t in range(-(-a // step) * step, b + 1, step)])
    both = rest.completed(spark, series, stored, ["BTC", "ETH"], 0, 24 * step, replay=str(tmp_path / "r"))
    for symbol in answers:
        got = sorted((r.time_ms // step, r.value) for r in both.where(F.col("symbol") == symbol).collect())
        assert [t for t, _ in got] == list(range(25))
        assert {t for t, v in got if v == "old"} == ({t // step for _, s, t, _, _ in old} if symbol == "BTC" else set())
    whole = spark.createDataFrame([(series, "BTC", t * step, "old", None) for t in range(25)], rest.SCHEMA)
    assert rest.completed(spark, series, whole, ["BTC"], 0, 24 * step, replay=str(tmp_path / "none")).count() == 25


def test_lanes_share_one_pace():
    found = rest.pages("binance_premium_1m", "BTC", 0, MINUTE * 1500 * 10 - 1)
    dealt = rest.lanes(found, 0.5, 4)
    assert len(dealt) == 4 and sorted(p.start for lane in dealt for p in lane.pages) == sorted(p.start for p in found)
    assert sum(1 / lane.pause for lane in dealt) == pytest.approx(1 / 0.5)
    assert [len(lane.pages) for lane in rest.lanes(found, 0, 4)] == [1] * len(found)
    assert [lane.pause for lane in rest.lanes(found, 2.0, 1)] == [2.0]


def test_answers_that_are_no_json_and_reads_that_time_out_are_asked_for_again(monkeypatch):
    import io

    tried = []

    class Answer(io.BytesIO):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    def urlopen(ask, timeout):
        tried.append(ask)
        if len(tried) == 1:
            return Answer(b"<html>busy</html>")
        if len(tried) == 2:
            raise TimeoutError("read")
        return Answer(b"[1]")

    monkeypatch.setattr(rest.urllib.request, "urlopen", urlopen)
    monkeypatch.setattr(rest.time, "sleep", lambda s: None)
    assert rest.fetch("http://x") == [1] and len(tried) == 3


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    series, step = "binance_premium_1h", rest.SERIES["binance_premium_1h"]["step"]
    rest.register(spark)

    def run(end, folder):
        q = spark.readStream.format("funding_series").options(series=series, symbols="BTC, ETH", start="0", end=str(end), replay=str(tmp_path / folder)).load()
        w = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            w.processAllAvailable()
        finally:
            w.stop()

    def answers(folder, a, b, symbols=("BTC", "ETH")):
        for symbol in symbols:
            for p in rest.pages(series, symbol, a, b):
                record(tmp_path / folder, p, p.start, p.end, [[t, "0", "0", "0", "v"] for t in range(-(-p.start // step) * step, p.end + 1, step)])

    answers("first", 0, 1999 * step)
    run(1999 * step, "first")
    answers("broken", 1999 * step + 1, 2500 * step, ("BTC",))  # one symbol's answer is lost: the batch fails
    with pytest.raises(Exception):
        run(2500 * step, "broken")
    answers("second", 1999 * step + 1, 2500 * step)  # the pages after the committed offset, and no others
    run(2500 * step, "second")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 * 2501 and got.select("symbol", "time_ms").distinct().count() == 2 * 2501
