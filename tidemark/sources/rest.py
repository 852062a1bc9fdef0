"""Paged REST series as a Spark data source.

Every venue's pages follow one of two cursors. Forward by spans: the wanted span is cut into pages
of a fixed number of steps, each an input partition of its own. Backward: newest first, the next
page ends before the oldest record; such a series is one partition per ``slice`` of the span.

The transport is ``urllib``; the option ``replay`` names a folder with one JSON file per request
instead (named by a digest of URL and body), which tests and offline runs use.
"""

from __future__ import annotations

import hashlib
import http.client
import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# fixed values: page sizes, addresses and field places of the venues' public interfaces
SERIES = {
    "binance_funding": {"url": "https://fapi.binance.com/fapi/v1/fundingRate?symbol={symbol}&startTime={start}&endTime={end}&limit=1000", "step": 28_800_000, "page": 1000, "rows": "", "time": "fundingTime", "value": "fundingRate"},
    "binance_premium_1h": {"url": "https://fapi.binance.com/fapi/v1/premiumIndexKlines?symbol={symbol}&interval=1h&startTime={start}&endTime={end}&limit=1500", "step": 3_600_000, "page": 1500, "rows": "", "time": 0, "value": 4},
    "binance_premium_1m": {"url": "https://fapi.binance.com/fapi/v1/premiumIndexKlines?symbol={symbol}&interval=1m&startTime={start}&endTime={end}&limit=1500", "step": 60_000, "page": 1500, "rows": "", "time": 0, "value": 4},
    "binance_price_1h": {"url": "https://fapi.binance.com/fapi/v1/klines?symbol={symbol}&interval=1h&startTime={start}&endTime={end}&limit=1500", "step": 3_600_000, "page": 1500, "rows": "", "time": 0, "value": 4},
    "binance_spot_1h": {"url": "https://api.binance.com/api/v3/klines?symbol={symbol}&interval=1h&startTime={start}&endTime={end}&limit=1000", "step": 3_600_000, "page": 1000, "rows": "", "time": 0, "value": 4},
    "bybit_funding": {"url": "https://api.bybit.com/v5/market/funding/history?category=linear&symbol={symbol}&startTime={start}&endTime={end}&limit=200", "step": 28_800_000, "page": 200, "rows": "result.list", "time": "fundingRateTimestamp", "value": "fundingRate", "backward": True},
    "bybit_premium_1h": {"url": "https://api.bybit.com/v5/market/premium-index-price-kline?category=linear&symbol={symbol}&interval=60&start={start}&end={end}&limit=1000", "step": 3_600_000, "page": 1000, "rows": "result.list", "time": 0, "value": 4, "backward": True},
    "bybit_premium_1m": {"url": "https://api.bybit.com/v5/market/premium-index-price-kline?category=linear&symbol={symbol}&interval=1&start={start}&end={end}&limit=1000", "step": 60_000, "page": 1000, "rows": "result.list", "time": 0, "value": 4},
    "hyperliquid_funding": {"url": "https://api.hyperliquid.xyz/info", "body": {"type": "fundingHistory", "coin": "{symbol}", "startTime": "{start}", "endTime": "{end}"}, "step": 3_600_000, "page": 500, "rows": "", "time": "time", "value": "fundingRate", "more": "premium"},
}
RETRY = (418, 429, 500, 502, 503, 504)
SCHEMA = "series string, symbol string, time_ms long, value string, more string"


def request_name(url: str, body: str | None) -> str:
    """File name of a recorded answer."""
    return hashlib.sha256(f"{url}\n{body or ''}".encode()).hexdigest()[:32] + ".json"


def fetch(url: str, body: str | None = None, retries: int = 6, pause: float = 0.0, replay: str | None = None):
    """Decoded JSON answer; repeats after rate limits and server errors, for as long as Retry-After says or doubling."""
    if replay:
        with open(f"{replay}/{request_name(url, body)}") as f:
            return json.load(f)
    for k in range(retries):
        time.sleep(pause)
        try:
            ask = urllib.request.Request(url, data=body.encode() if body else None, headers={"Content-Type": "application/json"})
            with urllib.request.urlopen(ask, timeout=30) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or k == retries - 1:
                raise
            time.sleep(float(e.headers.get("Retry-After") or 2**k))
        except (urllib.error.URLError, TimeoutError, ConnectionError, http.client.HTTPException, ValueError):  # ValueError: an answer that is no JSON
            if k == retries - 1:
                raise
            time.sleep(2**k)


@dataclass
class Page(InputPartition):
    series: str
    symbol: str
    start: int
    end: int


def pages(series: str, symbol: str, start: int, end: int, slices: int = 1) -> list[Page]:
    """Closed spans of a page's number of steps, which cover [start, end]; some slices for a backward series."""
    s = SERIES[series]
    width = s["step"] * (s["page"] - 1) if not s.get("backward") else -(-(end - start + 1) // slices)
    return [Page(series, symbol, a, min(a + width, end)) for a in range(start, end + 1, width + 1)]


def request_of(page: Page, start: int, end: int) -> tuple[str, str | None]:
    s = SERIES[page.series]
    fill = {"symbol": page.symbol, "start": start, "end": end}
    body = s.get("body")
    if body:
        body = json.dumps({k: v.format(**fill) if "{symbol}" in v or not v.startswith("{") else int(v.format(**fill)) for k, v in body.items()}, sort_keys=True)
    return s["url"].format(**fill), body


def rows_of(page: Page, **how):
    """(series, symbol, time_ms, value, more) of a partition, each stamp once, in the order of the answers."""
    s, seen, start, end = SERIES[page.series], set(), page.start, page.end
    while start <= end:
        answer = fetch(*request_of(page, start, end), **how)
        if isinstance(answer, dict) and answer.get("retCode", 0) != 0:
            raise ValueError(f"{page.series}: {answer.get('retMsg')}")
        for part in filter(None, s["rows"].split(".")):
            answer = answer[part]
        stamps = []
        for r in answer:
            t = int(r[s["time"]])
            stamps.append(t)
            if page.start <= t <= page.end and t not in seen:
                seen.add(t)
                yield page.series, page.symbol, t, str(r[s["value"]]), str(r[s["more"]]) if "more" in s else None
        if not stamps or len(stamps) < s["page"]:
            return
        if s.get("backward"):
            end = min(stamps) - 1
        else:
            start = max(stamps) + 1


@dataclass
class Lane(InputPartition):
    """Pages that are asked for one after the other, ``pause`` seconds apart."""

    pages: list[Page]
    pause: float


def lanes(found: list[Page], pause: float, most: int) -> list[Lane]:
    """Pages dealt to partitions. Without a pace each page is one; with it, up to ``most`` lanes share it: each waits ``most`` times as long, so that together they ask once per ``pause``."""
    if pause <= 0:
        return [Lane([p], 0.0) for p in found]
    n = max(1, min(most, len(found)))
    return [Lane(found[i::n], pause * n) for i in range(n)]


def read_lane(lane: Lane, replay: str | None):
    for page in lane.pages:
        yield from rows_of(page, pause=lane.pause, replay=replay)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options

    def partitions(self):
        slices = int(self.o.get("slices", "1"))
        if "spans" in self.o:  # symbol, start, end of what is to be fetched
            spans = [tuple(x) for x in json.loads(self.o["spans"])]
        else:
            spans = [(symbol.strip(), int(self.o["start"]), int(self.o["end"])) for symbol in self.o["symbols"].split(",")]
        found = [p for symbol, start, end in spans for p in pages(self.o["series"], symbol, start, end, slices)]
        if not found and "spans" not in self.o:
            raise ValueError("an empty span")
        return lanes(found, float(self.o.get("pause", "0")), int(self.o.get("lanes", "1"))) or [Lane([], 0.0)]

    def read(self, partition):
        yield from read_lane(partition, self.o.get("replay"))


class StreamReader(DataSourceStreamReader):
    """Pages as a stream: the offset is the first stamp not read yet, by symbol.

    A batch reaches from the committed offset to ``end`` or, without it, to now less ``delay``
    milliseconds. Spark keeps the offsets in the query's checkpoint, so a restart goes on where the
    last finished batch ended. All requests of a batch share one pace.
    """

    def __init__(self, options: dict[str, str]):
        self.o = options
        self.symbols = [x.strip() for x in options["symbols"].split(",")]

    def initialOffset(self) -> dict:
        return {symbol: int(self.o["start"]) for symbol in self.symbols}

    def latestOffset(self) -> dict:
        end = int(self.o["end"]) if "end" in self.o else int(time.time() * 1000) - int(self.o.get("delay", "0"))
        return {symbol: end + 1 for symbol in self.symbols}

    def partitions(self, start: dict, end: dict):
        first = int(self.o["start"])  # of a symbol that joined later
        found = [p for symbol in sorted(end) for p in pages(self.o["series"], symbol, start.get(symbol, first), end[symbol] - 1)]
        return lanes(found, float(self.o.get("pause", "0")), int(self.o.get("lanes", "1"))) or [Lane([], 0.0)]

    def read(self, partition):
        yield from read_lane(partition, self.o.get("replay"))

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are done."""


class FundingSeries(DataSource):
    """``spark.read.format("funding_series")``, or ``readStream``, with options series, symbols, start, end (ms), slices, replay.

    ``pause``: seconds between two requests of all partitions together, which are then ``lanes``.
    ``spans`` (batch): a JSON list of symbol, start, end instead of symbols, start and end. A stream
    needs no ``end``.
    """

    @classmethod
    def name(cls) -> str:
        return "funding_series"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(FundingSeries)


def fetched(spark, wanted: list[tuple[str, str]], start: int, end: int, **options: str):
    """All rows of several series (series, symbols joined by commas), as one table, after a check that every symbol of every series has answered with rows.

    The check counts rows by series and symbol (a row each on the driver); names of empty ones are raised.
    """
    from functools import reduce

    register(spark)
    reads = [spark.read.format("funding_series").options(series=s, symbols=symbols, start=str(start), end=str(end), **options).load() for s, symbols in wanted]
    rows = reduce(lambda a, b: a.unionByName(b), reads)
    have = {(r.series, r.symbol) for r in rows.groupBy("series", "symbol").count().collect()}
    empty = [(s, x.strip()) for s, symbols in wanted for x in symbols.split(",") if (s, x.strip()) not in have]
    if empty:
        raise ValueError(f"no rows for {empty}")
    return rows


def completed(spark, series: str, stored, symbols: list[str], start: int, end: int, **options: str):
    """The stored rows (SCHEMA) with what they lack of a span, fetched: only spans without stored stamps are asked for.

    The spans, a row each, come to the driver, where Spark plans partitions.
    """
    from pyspark.sql import functions as F

    from tidemark.sources.files import uncovered

    register(spark)
    wanted = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    have = stored.where((F.col("series") == series) & F.col("symbol").isin(symbols))
    spans = [(r.symbol, r.start, r.end) for r in uncovered(have, wanted, ["symbol"], "time_ms", SERIES[series]["step"], start, end).orderBy("symbol", "start").collect()]
    if not spans:
        return stored
    new = spark.read.format("funding_series").options(series=series, spans=json.dumps(spans), **options).load()
    return stored.unionByName(new)
