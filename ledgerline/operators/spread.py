"""Features, checks and drawdowns of symbols whose bars are too many for one task, as scans.

The recursive averages are affine in their last value, so a chunk's summary has the factor and the offset by
which it carries that value on; offsets are kept as what a chunk would give if it began at its own first
value, so a constant series stays exactly constant. Windows take the last bars of the chunks before as
a halo. The results are those of ``features`` and ``metrics.drawdown``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.parse import nan_to_null
from ledgerline.operators.features import REQUIRED, require
from ledgerline.operators.kernels import ema, wilder
from ledgerline.operators.scan import Scan, chunks, scan
from ledgerline.schemas import BAR_COLUMNS

#: The longest window reaches so many bars back.
HALO = 50
SPANS, PERIOD = (20, 50), 14
#: Beyond so many missing bars nothing is left of an average's last value.
FADED = 20_000


@dataclass
class Average:
    """An exponential average's last value, and how many missing bars follow it."""

    value: float
    gap: int = 0


@dataclass
class AverageStep:
    """What a chunk does to an average: bars before its first value (None without one), that value, the
    result if the average began there, its factor, and the missing bars at the end."""

    lead: int
    first: float | None
    result: float
    factor: float
    trail: int


def average_step(values: np.ndarray, span: int) -> AverageStep:
    known = np.flatnonzero(~np.isnan(values))
    if not len(known):
        return AverageStep(len(values), None, np.nan, 1.0, len(values))
    alpha = 2.0 / (span + 1)
    fade = (1 - alpha) ** np.diff(known).astype(float)
    factor = float(np.prod(fade / (fade + alpha))) if len(fade) else 1.0
    result = float(ema(pd.Series(values[known[0] :]), span).iloc[-1])
    return AverageStep(int(known[0]) + 1, float(values[known[0]]), result, factor, len(values) - 1 - int(known[-1]))


def after_step(state: Average | None, step: AverageStep, span: int) -> Average | None:
    if step.first is None:
        return state and Average(state.value, state.gap + step.trail)
    if state is None:
        return Average(step.result, step.trail)
    alpha = 2.0 / (span + 1)
    fade = (1 - alpha) ** (state.gap + step.lead)
    moved = fade / (fade + alpha) * (state.value - step.first)
    return Average(step.result + step.factor * moved, step.trail)


def continued(state: Average | None, values: np.ndarray, span: int) -> np.ndarray:
    """The average of a chunk that begins in a state."""
    if state is None:
        return ema(pd.Series(values), span).to_numpy()
    gap = min(state.gap, FADED)
    return ema(pd.Series(np.concatenate([[state.value], np.full(gap, np.nan), values])), span).to_numpy()[1 + gap :]


def ranges_of(high: np.ndarray, low: np.ndarray, close: np.ndarray, before: float) -> np.ndarray:
    """True ranges; ``before`` is the close before the first bar, NaN without one. Missing parts are
    left out of a bar's greatest."""
    last = np.concatenate([[before], close[:-1]])
    parts = np.stack([high - low, np.abs(high - last), np.abs(low - last)])
    return np.fmax(np.fmax(parts[0], parts[1]), parts[2])


@dataclass
class RangeState:
    """Bars so far, the first ranges until they make the seed, the smoothed value, and the last close."""

    bars: int
    seed: list[float]
    value: float
    close: float


@dataclass
class RangeStep:
    """A chunk's number of bars, its first bar's high and low, the ranges after it that a seed may need, the
    last close, and offset[j]: what the bars after the j-th add."""

    bars: int
    high: float
    low: float
    head: list[float]
    close: float
    offset: list[float] = field(default_factory=list)


def range_step(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int = PERIOD) -> RangeStep:
    n, keep = len(high), 1.0 - 1.0 / period
    later = ranges_of(high, low, close, np.nan)[1:] / period  # all but the first, which needs the close before
    offset = [0.0] * min(n, period)
    value = 0.0
    for x in later[len(offset) - 1 :].tolist():
        value = value * keep + x
    offset[-1] = value
    for j in range(len(offset) - 2, -1, -1):
        offset[j] = offset[j + 1] + keep ** (n - 2 - j) * later[j]
    return RangeStep(n, float(high[0]), float(low[0]), (later[: period - 1] * period).tolist(), float(close[-1]), offset)


def after_ranges(state: RangeState | None, step: RangeStep, period: int = PERIOD) -> RangeState:
    state = state or RangeState(0, [], np.nan, np.nan)
    keep = 1.0 - 1.0 / period
    first = float(ranges_of(np.array([step.high]), np.array([step.low]), np.array([0.0]), state.close)[0])
    bars = state.bars + step.bars
    if state.bars >= period:
        return RangeState(bars, [], (state.value * keep + first / period) * keep ** (step.bars - 1) + step.offset[0], step.close)
    seed = (state.seed + [first] + step.head)[: min(period, bars)]
    if bars < period:
        return RangeState(bars, seed, np.nan, step.close)
    known = [x for x in seed if not np.isnan(x)]
    value = sum(known) / len(known) if known else np.nan
    at = period - 1 - state.bars  # the bar of this chunk at which the seed is whole
    return RangeState(bars, [], value * keep ** (step.bars - 1 - at) + step.offset[at], step.close)


def smoothed(state: RangeState | None, ranges: np.ndarray, period: int = PERIOD) -> np.ndarray:
    """The average true range of a chunk that begins in a state."""
    if state is None or state.bars < period:
        before = state.seed if state else []
        return wilder(np.concatenate([before, ranges]), period)[len(before) :]
    out, value, keep = np.empty(len(ranges)), state.value, 1.0 - 1.0 / period
    for i, x in enumerate((ranges / period).tolist()):
        value = value * keep + x
        out[i] = value
    return out


def rolled(values: np.ndarray, n: int, how: str, skip: int) -> np.ndarray:
    """Mean or maximum of the last n values at each place from ``skip`` on; NaN where one is missing."""
    out = np.full(len(values), np.nan)
    if len(values) >= n:
        frames = np.lib.stride_tricks.sliding_window_view(values, n)
        out[n - 1 :] = frames.mean(axis=1) if how == "mean" else frames.max(axis=1)
    return out[skip:]


def divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


@dataclass
class FeatureState:
    close: np.ndarray
    volume: np.ndarray
    averages: dict[int, Average | None]
    ranges: RangeState


class Features(Scan):
    """All features of a symbol's bars in time order."""

    def summarize(self, rows: pd.DataFrame):
        close, volume, high, low = (rows[c].to_numpy(float) for c in ("close", "volume", "high", "low"))
        return close[-HALO:], volume[-HALO:], {s: average_step(close, s) for s in SPANS}, range_step(high, low, close)

    def advance(self, state: FeatureState | None, summary) -> FeatureState:
        close, volume, steps, ranges = summary
        if state:
            close, volume = np.concatenate([state.close, close])[-HALO:], np.concatenate([state.volume, volume])[-HALO:]
        return FeatureState(close, volume, {s: after_step(state.averages[s] if state else None, step, s) for s, step in steps.items()}, after_ranges(state.ranges if state else None, ranges))

    def apply(self, state: FeatureState | None, rows: pd.DataFrame) -> pd.DataFrame:
        close, volume, high, low = (rows[c].to_numpy(float) for c in ("close", "volume", "high", "low"))
        skip = len(state.close) if state else 0
        longer, volumes = (np.concatenate([state.close, close]), np.concatenate([state.volume, volume])) if state else (close, volume)
        average = rolled(volumes, 20, "mean", skip)
        ago = lambda n: np.concatenate([np.full(n, np.nan), longer])[skip : skip + len(close)]
        ranges = ranges_of(high, low, close, state.ranges.close if state else np.nan)
        return rows.assign(
            sma20=rolled(longer, 20, "mean", skip), sma50=rolled(longer, 50, "mean", skip), avg_volume_20=average, volume_ratio=divided(volume, average),
            momentum_5=divided(close, ago(5)) - 1, momentum_20=divided(close, ago(20)) - 1, true_range=ranges,
            previous_high_20=np.concatenate([[np.nan], rolled(longer, 20, "max", 0)])[skip : skip + len(close)],
            ema20=continued(state.averages[20] if state else None, close, 20), ema50=continued(state.averages[50] if state else None, close, 50),
            atr14=smoothed(state.ranges if state else None, ranges),
        )


ADDED = ("sma20", "sma50", "avg_volume_20", "volume_ratio", "momentum_5", "momentum_20", "true_range", "previous_high_20", "ema20", "ema50", "atr14")


def features(bars: DataFrame, symbols: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """``operators.features.features`` with no symbol bound to one task: one range shuffle, and two
    passes over its partitions."""
    require(bars, REQUIRED, "features")
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin([s.upper() for s in symbols]))
    bars = bars.where("symbol is not null").select("symbol", *(c for c in BAR_COLUMNS if c != "symbol"))
    schema = T.StructType([*bars.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ADDED)])
    done = scan(chunks(bars, "symbol", "date", partitions=partitions), ["symbol"], Features(), schema)
    doubles = [f.name for f in schema if isinstance(f.dataType, T.DoubleType)]
    return done.withColumns({c: nan_to_null(F.col(c)) for c in doubles}).select(*BAR_COLUMNS, *ADDED)


class Peak(Scan):
    """The running maximum of the equity: chunk maxima, carried on, fill the next chunks."""

    def summarize(self, rows: pd.DataFrame) -> float:
        return float(np.fmax.reduce(rows["equity"].to_numpy(float)))

    def advance(self, state: float | None, summary: float) -> float:
        return summary if state is None else float(np.fmax(state, summary))

    def apply(self, state: float | None, rows: pd.DataFrame) -> pd.DataFrame:
        equity = rows["equity"].to_numpy(float)
        peak = np.fmax.accumulate(equity if state is None else np.concatenate([[state], equity]))
        peak = peak if state is None else peak[1:]
        return rows.assign(peak=peak, drawdown=divided(equity - peak, peak))


def drawdown(curve: DataFrame, partitions: int | None = None) -> DataFrame:
    """``metrics.drawdown`` of curves (symbol, run_id, date, equity) of any length."""
    rows = curve.select("symbol", "run_id", *(c for c in curve.columns if c not in ("symbol", "run_id")))
    schema = T.StructType([*rows.schema.fields, T.StructField("peak", T.DoubleType()), T.StructField("drawdown", T.DoubleType())])
    done = scan(chunks(rows, "symbol", "run_id", "date", partitions=partitions), ["symbol", "run_id"], Peak(), schema)
    return done.withColumns({c: nan_to_null(F.col(c)) for c in ("equity", "peak", "drawdown")})


def peaked(tagged: DataFrame, partitions: int | None = None) -> DataFrame:
    """Tagged rows with the running peak of their run's equity, as metrics_and_span() reads them. Of what the
    scan moves, a row has its place and its equity only."""
    rows = tagged.select("symbol", "run_id", "seq", "kind", "initial_capital", "trade", "skip", "span", F.col("equity").alias("bar"), F.col("equity.equity").alias("equity"))
    values = rows.where("kind = 'equity'").select("symbol", "run_id", "seq", F.col("bar.position_quantity").alias("position_quantity"), "equity", "initial_capital")
    schema = T.StructType([*values.schema.fields, T.StructField("peak", T.DoubleType()), T.StructField("drawdown", T.DoubleType())])
    done = scan(chunks(values, "symbol", "run_id", "seq", partitions=partitions), ["symbol", "run_id"], Peak(), schema)
    curve = done.select("symbol", "run_id", "seq", F.lit("equity").alias("kind"), "initial_capital", F.struct("equity", "position_quantity").alias("equity"), nan_to_null(F.col("peak")).alias("peak"))
    others = tagged.where("kind <> 'equity'").select("symbol", "run_id", "seq", "kind", "initial_capital", "trade", "skip", "span", F.lit(None).cast("double").alias("peak"))
    return curve.unionByName(others, allowMissingColumns=True)


class Steps(Scan):
    """What compares a row with the one before it: whether its date goes back, and its change."""

    def summarize(self, rows: pd.DataFrame) -> tuple[float, float]:
        return float(rows["day"].iloc[-1]), float(rows["close"].iloc[-1])

    def advance(self, state, summary: tuple[float, float]) -> tuple[float, float]:
        return summary

    def apply(self, state: tuple[float, float] | None, rows: pd.DataFrame) -> pd.DataFrame:
        last = state or (np.nan, np.nan)
        day, close = rows["day"].to_numpy(float), rows["close"].to_numpy(float)
        before, was = np.concatenate([[last[0]], day[:-1]]), np.concatenate([[last[1]], close[:-1]])
        known = ~np.isnan(day) & ~np.isnan(before)
        return rows.assign(backward=pd.array(np.where(known, day <= before, False), dtype="boolean"), known=known, computed=divided(close, was) - 1)


def stepped(bars: DataFrame, partitions: int | None = None) -> DataFrame:
    """(symbol, date, the source's row, change_pct_src, backward, computed, difference): quality's comparison of
    each row with the one before, in the order of dates and of the source. Rows without a symbol are no
    symbol's."""
    place = [c for c in ("_src_row",) if c in bars.columns]
    change = F.col("change_pct_src").cast("double") if "change_pct_src" in bars.columns else F.lit(None).cast("double")
    day = F.when(F.col("date").isNotNull(), F.unix_micros(F.col("date").cast("timestamp")).cast("double"))
    narrow = bars.where("symbol is not null").select("symbol", "date", *place, change.alias("change_pct_src"), day.alias("day"), F.col("close").cast("double").alias("close"))
    schema = T.StructType([*narrow.schema.fields, T.StructField("backward", T.BooleanType()), T.StructField("known", T.BooleanType()), T.StructField("computed", T.DoubleType())])
    done = scan(chunks(narrow, "symbol", F.col("date").asc_nulls_last(), *place, partitions=partitions), ["symbol"], Steps(), schema)
    change, computed = nan_to_null(F.col("change_pct_src")), nan_to_null(F.col("computed"))
    return done.select("symbol", "date", *place, change.alias("change_pct_src"), F.when(F.col("known"), F.col("backward")).alias("backward"), computed.alias("computed"), F.abs(computed - change).alias("difference"))


class Places(Scan):
    """Each row's number within its key, from 0."""

    def summarize(self, rows: pd.DataFrame) -> int:
        return len(rows)

    def advance(self, state: int | None, summary: int) -> int:
        return (state or 0) + summary

    def apply(self, state: int | None, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(place=(state or 0) + np.arange(len(rows)))


def downsample(df: DataFrame, most: int, column: str, keep_last: bool = True, partitions: int | None = None) -> DataFrame:
    """query.downsample() of (symbol, date, column), with no symbol bound to one task; rows without a symbol are
    no symbol's. A row per symbol says how many rows it has."""
    rows = df.where("symbol is not null").select("symbol", "date", column)
    n = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    schema = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())])
    placed = scan(chunks(rows, "symbol", "date", partitions=partitions), ["symbol"], Places(), schema)
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    keep = F.col("place") % step == 0
    found = placed.join(n, "symbol").where(keep | (F.col("place") == F.col("n") - 1) if keep_last else keep)
    value = nan_to_null(F.col(column)) if dict(rows.dtypes)[column] == "double" else F.col(column)
    return found.select("symbol", "date", value.alias(column))
