"""The two sequential parts, as plain functions over one group in time order.

``recursive`` holds the averages whose state is unbounded; ``simulate`` is the position state
machine, which looks at bars with a signal or an open position only. Both are free of Spark.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd

STOP_GAP, STOP_LOSS, TREND_EXIT, END_OF_DATA = "STOP_GAP", "STOP_LOSS", "TREND_EXIT", "END_OF_DATA"
NO_NEXT_DAY, ZERO_ATR, ZERO_QTY, IN_POSITION, NO_PRICE = "SKIPPED_NO_NEXT_DAY", "SKIPPED_ZERO_ATR", "SKIPPED_ZERO_QTY", "SKIPPED_IN_POSITION", "SKIPPED_NO_PRICE"
DETAILS = {
    NO_NEXT_DAY: "no bar follows the signal",
    ZERO_ATR: "the average true range is missing or not positive",
    ZERO_QTY: "risk budget or cash buys less than one share",
    IN_POSITION: "a position is open",
    NO_PRICE: "the next bar has no usable open",
}


def ema(values: pd.Series, span: int) -> pd.Series:
    """e0 = c0, then (1 - a) e + a c with a = 2 / (span + 1); a gap repeats the value and lets
    its weight fade."""
    if span < 1:
        raise ValueError("span must be at least 1")
    return values.ewm(span=span, adjust=False, ignore_na=False).mean()


def wilder(ranges: np.ndarray, period: int = 14) -> np.ndarray:
    """Seeded with the mean of the first ``period`` ranges; a missing range later ends it."""
    if period < 1:
        raise ValueError("period must be at least 1")
    out = np.full(len(ranges), np.nan)
    if len(ranges) < period:
        return out
    seed = ranges[:period]
    known = seed[~np.isnan(seed)]
    value = known.sum() / len(known) if len(known) else np.nan
    keep, add = 1.0 - 1.0 / period, ranges / period
    out[period - 1] = value
    for i, x in enumerate(add[period:].tolist(), period):
        value = value * keep + x
        out[i] = value
    return out


def recursive(group: pd.DataFrame) -> pd.DataFrame:
    """Adds ema20, ema50 and atr14 to one symbol's bars (with true_range)."""
    g = group.sort_values("date", kind="stable")
    close = g["close"].astype(float)
    return g.assign(ema20=ema(close, 20), ema50=ema(close, 50), atr14=wilder(g["true_range"].to_numpy(float)))


@dataclass(frozen=True)
class Config:
    initial_capital: float = 100_000.0
    risk_per_trade: float = 0.01
    atr_multiplier: float = 2.0
    slippage_rate: float = 0.0005
    commission_rate: float = 0.0005

    def __post_init__(self) -> None:
        if not self.initial_capital > 0:
            raise ValueError("initial_capital must be positive")
        if not 0 < self.risk_per_trade <= 1:
            raise ValueError("risk_per_trade must be in (0, 1]")
        if not self.atr_multiplier > 0:
            raise ValueError("atr_multiplier must be positive")


def entry_price(reference: float, slippage: float) -> float:
    return reference * (1 + slippage)


def exit_price(reference: float, slippage: float) -> float:
    return reference * (1 - slippage)


def commission(price: float, quantity: int, rate: float) -> float:
    return price * quantity * rate


@dataclass
class Bars:
    """One symbol's bars in time order, a list per column; a missing number is NaN."""

    date: list[str]
    day: list[int]
    open: list[float]
    low: list[float]
    close: list[float]
    ema20: list[float]
    atr14: list[float]
    long: list[bool]

    def part(self, first: int, last: int) -> Bars:
        return Bars(*(getattr(self, f.name)[first:last] for f in fields(self)))


@dataclass
class Run:
    """What a run carries from one part of its bars to the next."""

    cash: float
    held: Position | None = None
    trades: int = 0
    bars: int = 0


@dataclass
class Ledger:
    """What a run did: trades and skipped signals with the places of their bars, and cash and shares
    after each bar."""

    cash: np.ndarray
    quantity: np.ndarray
    trades: list[tuple] = field(default_factory=list)
    trade_at: list[int] = field(default_factory=list)
    skips: list[tuple] = field(default_factory=list)
    skip_at: list[int] = field(default_factory=list)


@dataclass
class Position:
    signal_date: str
    entry_date: str
    entry_day: int
    reference: float
    price: float
    stop: float
    atr: float
    quantity: int
    budget: float
    leaving: bool = False


def _exit(p: Position, bars: Bars, i: int, last: bool) -> tuple[str, float] | None:
    if bars.open[i] < p.stop:
        return STOP_GAP, bars.open[i]
    if bars.low[i] <= p.stop:
        return STOP_LOSS, p.stop
    if p.leaving:
        return TREND_EXIT, bars.open[i]
    return (END_OF_DATA, bars.close[i]) if last else None


def _enter(bars: Bars, i: int, cash: float, c: Config) -> Position | str:
    """The position that the signal of bar i buys at the next open; the equity at risk is the cash."""
    if i + 1 == len(bars.close):
        return NO_NEXT_DAY
    if not bars.atr14[i] > 0:
        return ZERO_ATR
    if not bars.open[i + 1] > 0:
        return NO_PRICE
    reference = bars.open[i + 1]
    price = entry_price(reference, c.slippage_rate)
    stop = price - c.atr_multiplier * bars.atr14[i]
    budget = cash * c.risk_per_trade
    # Cash need not cover the commission.
    quantity = min(math.floor(budget / (price - stop)), math.floor(cash / price))
    return Position(bars.date[i], bars.date[i + 1], bars.day[i + 1], reference, price, stop, bars.atr14[i], quantity, budget) if quantity > 0 else ZERO_QTY


def _close(p: Position, bars: Bars, i: int, reason: str, reference: float, number: int, c: Config) -> tuple[tuple, float]:
    """The trade's row, and what the sale brings in."""
    price, n = exit_price(reference, c.slippage_rate), p.quantity
    paid = commission(price, n, c.commission_rate)
    costs = commission(p.price, n, c.commission_rate) + paid
    gross = (price - p.price) * n
    net = gross - costs
    returned = net / (p.price * n) if p.price * n else 0.0
    multiple = net / p.budget if p.budget else 0.0
    length = max(0, bars.day[i] - p.entry_day)
    row = (number, p.signal_date, p.entry_date, p.reference, p.price, p.stop, p.atr, n, p.budget, bars.date[i], reference, price, reason, gross, costs, net, returned, multiple, length)
    return row, price * n - paid


def simulate(bars: Bars, c: Config) -> Ledger:
    """A run over all bars. A signal's purchase is booked on its own bar at the next bar's open, so the
    equity of the signal bar already shows the position; the stop is live from the entry bar on."""
    return resume(Run(c.initial_capital), bars, c)


def resume(run: Run, bars: Bars, c: Config, ended: bool = True) -> Ledger:
    """The next part of a run, which is carried on. The last of the bars is the run's last one or, unless
    ``ended``, waits: it only tells what the bar before it needs, and is the first of the next part."""
    n = len(bars.close) if ended else max(0, len(bars.close) - 1)
    out = Ledger(np.full(n, run.cash), np.zeros(n, np.int64))
    signals = np.flatnonzero(bars.long[:n])
    cash, held, i = run.cash, run.held, 0
    while i < n:
        if held is None:
            k = int(np.searchsorted(signals, i))
            upto = int(signals[k]) if k < len(signals) else n
            out.cash[i:upto], i = cash, upto
            if i == n:
                break
        elif found := _exit(held, bars, i, ended and i == n - 1):
            run.trades += 1
            row, income = _close(held, bars, i, *found, run.trades, c)
            out.trades.append(row)
            out.trade_at.append(run.bars + i)
            cash, held = cash + income, None
        elif bars.close[i] < bars.ema20[i]:
            held.leaving = True
        if bars.long[i]:
            got = IN_POSITION if held else _enter(bars, i, cash, c)
            if isinstance(got, str):
                out.skips.append((bars.date[i], got, DETAILS[got]))
                out.skip_at.append(run.bars + i)
            else:
                held = got
                cash = cash - held.price * held.quantity - commission(held.price, held.quantity, c.commission_rate)
        out.cash[i], out.quantity[i] = cash, held.quantity if held else 0
        i += 1
    run.cash, run.held, run.bars = cash, held, run.bars + n
    return out
