"""Files with fixed schemas. Printed rates stay text until an operator needs them exact."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.periods import parse_stamp, shifted
from tidemark.operators.scan import carried, same

# fixed values: column orders of the files
CANDLES = "time timestamp_ntz, o double, h double, l double, c double, v double"
FUNDING = "time timestamp_ntz, fundingRate string, premium string"
SETTLEMENTS = "time timestamp_ntz, fundingRate string, markPrice string"
MINUTES = "open_ms long, open string, high string, low string, close string, n string"
HOURS = "time timestamp_ntz, n int, mean string, lwmean string, close string"
PRICES = "open_time timestamp_ntz, close string"
TICKS = "exchange string, symbol string, timestamp long, local_timestamp long, id long, side string, price double, amount double"
CONTEXT_NAMES = {
    "time": ("time", "timestamp", "ts"),
    "coin": ("coin", "symbol", "asset"),
    "funding": ("funding", "fundingrate"),
    "premium": ("premium",),
    "oracle_px": ("oraclepx", "oracleprice"),
    "mark_px": ("markpx", "markprice"),
    "mid_px": ("midpx", "midprice"),
}
NEEDED = ("time", "coin", "funding", "premium")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file or folder (also gzip) with a header; a value that does not fit the schema is an error, an empty one is null."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nullValue", "").csv(path)


def panel(spark: SparkSession, path: str, checked: bool = True) -> DataFrame:
    """A panel from CSV or Parquet by suffix, with the five candle columns or more; unsorted, repeated or null stamps are an error."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(path)
    lacking = {"time", "o", "h", "l", "c"} - set(rows.columns)
    if lacking:
        raise ValueError(f"columns missing: {', '.join(sorted(lacking))}")
    rows = rows.withColumn("time", F.col("time").cast("timestamp_ntz"))
    if checked:
        bad = rows.agg(F.count_if(F.col("time").isNull()).alias("null_time"), F.count_if(F.col("c").isNull() | F.isnan("c")).alias("null_close"), (F.count("time") - F.count_distinct("time")).alias("repeated")).first().asDict()
        if any(bad.values()):
            raise ValueError(f"bad rows: {bad}")
    return rows


def number(text: Column) -> Column:
    """A double from text; null for empty text and for anything that is no finite number."""
    x = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def hourly_premium(rows: DataFrame) -> DataFrame:
    """(time, n, mean, lwmean, close) of an hourly file in bps."""
    return rows.select("time", "n", *((number(F.col(c)) * 10000).alias(c) for c in ("mean", "lwmean", "close")))


def closes(rows: DataFrame, log: bool = False) -> DataFrame:
    """Closes stamped when the bar ends; with ``log``, as 10,000 times the logarithm."""
    c = number(F.col("close"))
    return rows.select(shifted(F.col("open_time"), 3600).alias("time"), (F.ln(c) * 10000 if log else c).alias("close"))


def resolved(rows: DataFrame, names: Mapping[str, tuple[str, ...]] = CONTEXT_NAMES, needed: tuple[str, ...] = NEEDED) -> DataFrame:
    """Columns under their canonical names, found whatever their case, underscores and order; an error if a needed one is missing."""
    plain = lambda s: s.strip().lower().replace("_", "").replace(" ", "")
    have = {plain(c): c for c in rows.columns}
    found = {k: next((have[a] for a in aliases if a in have), None) for k, aliases in names.items()}
    lacking = [k for k in needed if found[k] is None]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    return rows.select(*(F.col(f"`{c}`").alias(k) for k, c in found.items() if c))


def context(rows: DataFrame, coin: str) -> DataFrame:
    """Typed archive context of one coin: time (epoch seconds, milliseconds or ISO text), funding, premium and prices."""
    return typed_context(resolved(rows.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns))), coin)


def typed_context(r: DataFrame, coin: str) -> DataFrame:
    """The rows of one coin from a context of texts under canonical names."""
    rest = [c for c in r.columns if c not in ("time", "coin")]
    return r.where(F.upper(F.trim("coin")) == coin.upper()).select(parse_stamp(F.col("time")).alias("time"), *(number(F.col(c)).alias(c) for c in rest)).where("time is not null")


def holes(stored: DataFrame, keys: list[str], time: str, step: int, start: int, end: int) -> DataFrame:
    """(keys, start, end): closed spans of [start, end] in which a key's stamps lack steps; whole numbers of one unit.

    Stamps that stand ``step`` apart or closer leave no hole. What precedes a stamp is carried over
    blocks, so no task holds a series. Keys without any stamp are not there: see ``uncovered``.
    """
    s = stored.select(*keys, F.col(time).cast("long").alias("_t")).where(F.col("_t").between(start, end)).distinct()
    s = carried(s, keys, "_t", {"_prev": F.col("_t")})
    between = s.select(*keys, F.coalesce(F.col("_prev") + step, F.lit(start)).alias("start"), (F.col("_t") - step).alias("end"), F.col("_prev").isNull().alias("_first"), "_t")
    between = between.select(*keys, "start", F.when(F.col("_first"), F.col("_t") - 1).otherwise(F.col("end")).alias("end")).where(F.col("start") <= F.col("end"))
    after = s.groupBy(*keys).agg((F.max("_t") + step).alias("start")).select(*keys, "start", F.lit(end).cast("long").alias("end")).where(F.col("start") <= end)
    return between.unionByName(after)


def uncovered(stored: DataFrame, wanted: DataFrame, keys: list[str], time: str, step: int, start: int, end: int) -> DataFrame:
    """(keys, start, end): the spans that a store of stamps lacks for each key of ``wanted``; the whole of it where nothing is stored."""
    found = holes(stored, keys, time, step, start, end)
    asked = wanted.select(*keys).distinct()
    none = same(asked, stored.where(F.col(time).between(start, end)).select(*keys).distinct(), keys, "left_anti")
    return same(found, asked, keys, "left_semi").unionByName(none.select(*keys, F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end")))


def covers(minutes: DataFrame, start: str, end: str) -> bool:
    """Whether a cached minute table has every minute of a span, its end left out."""
    ms = minutes.sparkSession.range(1).select(F.unix_millis(F.lit(start).cast("timestamp")).alias("a"), (F.unix_millis(F.lit(end).cast("timestamp")) - 60_000).alias("b")).first()
    one = minutes.select(F.lit(1).alias("_k"), "open_ms")
    return uncovered(one, one.sparkSession.range(1).select(F.lit(1).alias("_k")), ["_k"], "open_ms", 60_000, ms.a, ms.b).isEmpty()


def write_csv(rows: DataFrame, path: str, compression: str = "none") -> int:
    """CSV with a header and LF line ends; the number of rows, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("header", True).option("lineSep", "\n").option("compression", compression).csv(path)
    return int(seen.get["n"])
