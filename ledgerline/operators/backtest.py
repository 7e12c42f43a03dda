"""Backtests: one grouped map over symbols, for any number of runs.

A run is a configuration and, for walk-forward windows, a range of dates. Bars are shuffled once, by
symbol, and all runs of a symbol read the same columns: configurations go along with the task, a
symbol's windows are cogrouped with its bars. Trades, equity rows, skipped signals and the ends of
the run's bars leave as one tagged row type, so each run is simulated once however many are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.features import LONG, require
from ledgerline.operators.kernels import Bars, Config, Ledger, simulate
from ledgerline.schemas import CONFIG_FIELDS, EQUITY_FIELDS, SKIP_FIELDS, SPAN_FIELDS, TRADE_FIELDS, ddl

REQUIRED = ("date", "symbol", "open", "high", "low", "close", "ema20", "atr14", "signal")
KINDS = {"trade": TRADE_FIELDS, "equity": EQUITY_FIELDS, "skip": SKIP_FIELDS, "span": SPAN_FIELDS}
TAGGED = "kind string, symbol string, run_id string, seq long, initial_capital double, " + ", ".join(f"{kind} struct<{', '.join(f'{n}:{t}' for n, t in fields)}>" for kind, fields in KINDS.items())
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
_STRUCTS = {kind: pa.struct([(n, _ARROW[t]) for n, t in fields]) for kind, fields in KINDS.items()}


def config_table(spark: SparkSession, configs: dict[str, Config]) -> DataFrame:
    rows = [(k, c.initial_capital, c.risk_per_trade, c.atr_multiplier, c.slippage_rate, c.commission_rate) for k, c in configs.items()]
    return spark.createDataFrame(rows, ddl(CONFIG_FIELDS))


def tagged_rows(kind: str, columns: list, seq: list | np.ndarray, symbol: str, run_id: str, capital: float) -> pa.Table:
    """Rows of one kind: its columns as a struct, the other structs null."""
    n = len(seq)
    struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STRUCTS[kind])], fields=list(_STRUCTS[kind]))
    known = [pa.array([kind] * n, pa.string()), pa.array([symbol] * n, pa.string()), pa.array([run_id] * n, pa.string()), pa.array(seq, pa.int64()), pa.array([capital] * n, pa.float64())]
    structs = [struct if k == kind else pa.nulls(n, t) for k, t in _STRUCTS.items()]
    return pa.Table.from_arrays([*known, *structs], names=["kind", "symbol", "run_id", "seq", "initial_capital", *_STRUCTS])


def _run(bars: Bars, symbol: str, run_id: str, c: Config) -> Iterator[pa.Table]:
    yield from rows_of(simulate(bars, c), bars, 0, (symbol, run_id, c.initial_capital))
    if bars.date:
        yield tagged_rows("span", [[bars.date[0]], [bars.date[-1]], [bars.open[0]], [bars.close[-1]], [len(bars.date)]], [-1], symbol, run_id, c.initial_capital)


def rows_of(done: Ledger, bars: Bars, first: int, about: tuple[str, str, float]) -> Iterator[pa.Table]:
    """The tagged rows of a run's part, the first of whose bars is the run's ``first``-th."""
    n = len(done.cash)
    if done.trades:
        yield tagged_rows("trade", list(zip(*done.trades)), [4 * i for i in done.trade_at], *about)
    if done.skips:
        yield tagged_rows("skip", list(zip(*done.skips)), [4 * i + 1 for i in done.skip_at], *about)
    worth = np.where(done.quantity > 0, done.quantity * np.array(bars.close[:n], float), 0.0)
    curve = [bars.date[:n], np.round(done.cash, 6), done.quantity, np.round(worth, 6), np.round(done.cash + worth, 6)]
    yield tagged_rows("equity", curve, 4 * (first + np.arange(n)) + 2, *about)


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def kernel_bars(table: DataFrame, *more: str) -> DataFrame:
    """The columns that runs read: dates as text (ISO text keeps the order of dates and of timestamps), as
    microseconds and as days, numbers without nulls."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    return table.select(
        "symbol", F.col("date").cast("string").alias("date"), _micros("date").alias("at"), F.unix_date(F.to_date("date")).cast("long").alias("day"),
        *map(number, ("open", "low", "close", "ema20", "atr14")), F.coalesce(F.col("signal") == LONG, F.lit(False)).alias("long"), *more,
    )


def run_backtests(table: DataFrame, configs: dict[str, Config], windows: DataFrame | None = None, window_config: Config = Config()) -> DataFrame:  # noqa: B008 - immutable
    """Tagged rows of every run: each of ``configs`` over all bars, and ``window_config`` over each of
    ``windows`` (symbol, run_id, first_date, last_date; inclusive)."""
    require(table, REQUIRED, "backtest")
    bars = kernel_bars(table)

    def kernel(group: pa.Table, ranges: pa.Table | None = None) -> pa.Table:
        parts: list[pa.Table] = []
        if group.num_rows:
            t = group.sort_by("at")
            own, symbol, at = Bars(*(t[c].to_pylist() for c in Bars.__dataclass_fields__)), t["symbol"][0].as_py(), t["at"].to_numpy()
            for run_id, c in configs.items():
                parts += _run(own, symbol, run_id, c)
            for r in ranges.to_pylist() if ranges is not None else ():
                first, last = np.searchsorted(at, r["low"], side="left"), np.searchsorted(at, r["high"], side="right")
                parts += _run(own.part(int(first), int(last)), symbol, r["run_id"], window_config)
        return pa.concat_tables(parts) if parts else _NOTHING

    if windows is None:
        return bars.groupBy("symbol").applyInArrow(lambda group: kernel(group), TAGGED)
    # A name of its own: windows come from the same table as a rule.
    ranges = windows.select(F.col("symbol").alias("owner"), "run_id", _micros("first_date").alias("low"), _micros("last_date").alias("high"))
    return bars.groupBy("symbol").cogroup(ranges.groupBy("owner")).applyInArrow(lambda group, ranges: kernel(group, ranges), TAGGED)


_NOTHING = tagged_rows("span", [[]] * len(SPAN_FIELDS), [], "", "", 0.0)


def trades(tagged: DataFrame) -> DataFrame:
    return tagged.where("kind = 'trade'").select("symbol", "run_id", "trade.*")


def equity(tagged: DataFrame) -> DataFrame:
    return tagged.where("kind = 'equity'").select("symbol", "run_id", "equity.*")


def skips(tagged: DataFrame) -> DataFrame:
    return tagged.where("kind = 'skip'").select("symbol", "run_id", "skip.*")


def total_transaction_cost(entry, exit_, quantity, rate):
    """Both legs' commissions, as a column."""
    return (entry + exit_) * quantity * rate
