"""Funding records and ticks as streams: windowed counts with late data, bars, and a causal state filter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.functions import funding as X


def records(events: DataFrame) -> DataFrame:
    """Streaming records from an event stream (event_type, ts, value): venue, ts (timestamp), p and r in milli-bps."""
    p = F.round(F.col("value") * 100).cast("long") - 5000
    e = events.select(F.col("event_type").alias("venue"), F.col("ts").cast("timestamp").alias("ts"), p.alias("p"))
    return e.withColumn("r", F.col("p") + F.greatest(F.least(1000 - F.col("p"), F.lit(5000)), F.lit(-5000)))


def floor_share(stream: DataFrame, window: str = "8 hours", late: str = "30 minutes") -> DataFrame:
    """Records and records at the floor per venue and window; records later than the watermark are dropped."""
    g = stream.withWatermark("ts", late).groupBy("venue", F.window("ts", window))
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("r") == 1000).alias("at_floor")).select("venue", F.col("window.end").alias("block"), "n", "at_floor")


def hourly_bars(stream: DataFrame, late: str = "30 minutes") -> DataFrame:
    """OHLC of the premium per venue and hour."""
    g = stream.withWatermark("ts", late).groupBy("venue", F.window("ts", "1 hour"))
    return g.agg(F.min_by("p", "ts").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "ts").alias("close"), F.count("*").alias("n")).select("venue", F.col("window.start").alias("bar"), "open", "high", "low", "close", "n")


def first_per_hour(stream: DataFrame, late: str = "30 minutes") -> DataFrame:
    """The first record to arrive of every venue and hour; the state of an hour is dropped after the watermark."""
    return stream.withColumn("hour", F.date_trunc("hour", "ts")).withWatermark("hour", late).dropDuplicatesWithinWatermark(["venue", "hour"])


def state_filter(stream: DataFrame, pi, a, mu, sigma) -> DataFrame:
    """(venue, ts, p, probabilities): causal probabilities of a Gaussian chain's states, carried from batch to batch per venue."""
    k = len(pi)
    pi, a, mu, sigma = (np.asarray(v, float) for v in (pi, a, mu, sigma))

    def update(key, frames, state):
        import pandas as pd

        ahead = np.array(state.get[0]) if state.exists else pi
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for x in rows["p"].to_numpy() / 1000.0:
            b = np.exp(-0.5 * ((x - mu) / sigma) ** 2) / sigma
            now = ahead * b
            now = now / now.sum() if now.sum() > 0 else ahead
            out.append(now.tolist())
            ahead = now @ a
        state.update((ahead.tolist(),))
        yield pd.DataFrame({"venue": key[0], "ts": rows["ts"].to_numpy(), "p": rows["p"].to_numpy(), "probabilities": out})

    assert k == len(mu) == len(sigma)
    return stream.groupBy("venue").applyInPandasWithState(update, "venue string, ts timestamp, p long, probabilities array<double>", "ahead array<double>", "append", "NoTimeout")
