"""Streaming bars and signals' state: an extension beyond batch.

Bars close when the watermark passes them. The recursive averages live in a keyed state that
holds their last values only, and take the same steps as the batch kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_bars(events: DataFrame, width: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """OHLCV per event type and window, of a stream (or a batch) of events."""
    e = events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    order, value = F.struct("ts", "event_id"), F.col("value")
    bars = e.groupBy(F.window("event_time", width).alias("w"), F.col("event_type").alias("symbol")).agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.sum(value).alias("volume"))
    return bars.select(F.col("w.start").alias("date"), "symbol", "open", "high", "low", "close", "volume")


STATE = "ema20 double, ema50 double, close double, atr double, seed double, n long"
OUT = "date timestamp, symbol string, close double, ema20 double, ema50 double, atr14 double"


def step(state: tuple | None, high: float, low: float, close: float, period: int = 14) -> tuple:
    """(ema20, ema50, close, atr, seed, n) after one more bar; seed sums the first ranges."""
    if state is None:
        span = high - low
        return close, close, close, span if period == 1 else float("nan"), span, 1
    e20, e50, before, atr, seed, n = state
    span = max(high - low, abs(high - before), abs(low - before))
    n += 1
    e20, e50 = e20 + (close - e20) * 2 / 21, e50 + (close - e50) * 2 / 51
    seed = seed + span if n <= period else seed
    atr = seed / period if n == period else atr * (1 - 1 / period) + span / period if n > period else float("nan")
    return e20, e50, close, atr, seed, n


def streaming_averages(bars: DataFrame) -> DataFrame:
    """The averages of each symbol's closed bars, in a stateful operator."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        rows = []
        for f in sorted((x for frame in frames for x in frame.itertuples()), key=lambda x: x.date):
            now = step(now, f.high, f.low, f.close)
            rows.append((f.date, key[0], f.close, now[0], now[1], now[3]))
        if now is not None:
            state.update(tuple(map(float, now[:5])) + (int(now[5]),))
        yield pd.DataFrame(rows, columns=["date", "symbol", "close", "ema20", "ema50", "atr14"])

    return bars.groupBy("symbol").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
