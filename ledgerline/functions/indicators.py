"""Trailing indicators over one symbol's bars in time order. None looks ahead; a mean or extreme
is null until its frame is full of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: One window specification for all, so that one exchange and one sort serve every feature.
def by_symbol(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("date")


def _full(value: Column, c: Column, n: int, frame: WindowSpec) -> Column:
    return F.when(F.count(c).over(frame) == n, value.over(frame))


def sma(c: Column, n: int, w: WindowSpec) -> Column:
    return _full(F.avg(c), c, n, w.rowsBetween(1 - n, 0))


def previous_high(c: Column, n: int, w: WindowSpec) -> Column:
    """The highest of the n bars before this one."""
    return _full(F.max(c), c, n, w.rowsBetween(-n, -1))


def true_range(high: Column, low: Column, close: Column, w: WindowSpec) -> Column:
    """greatest() skips nulls, so the first bar's range is high - low."""
    before = F.lag(close).over(w)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def momentum(c: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(c, F.lag(c, n).over(w)) - 1


def volume_ratio(volume: Column, average: Column) -> Column:
    return F.try_divide(volume, average)


def with_windowed(bars: DataFrame, w: WindowSpec | None = None) -> DataFrame:
    """All features that a bounded frame can express, and two helpers of later steps:
    true_range and previous_high_20."""
    w = w or by_symbol()
    close, volume = F.col("close"), F.col("volume")
    average = sma(volume, 20, w)
    return bars.withColumns({
        "sma20": sma(close, 20, w), "sma50": sma(close, 50, w), "avg_volume_20": average, "volume_ratio": volume_ratio(volume, average),
        "momentum_5": momentum(close, 5, w), "momentum_20": momentum(close, 20, w),
        "true_range": true_range(F.col("high"), F.col("low"), close, w), "previous_high_20": previous_high(close, 20, w),
    })
