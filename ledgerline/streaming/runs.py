"""Backtests that new bars continue: the position state machine over a stream.

The state of a symbol is, for each run, its cash, its open position and its counts, and the last bar,
which waits for the next one (a signal is filled at the next open). A micro-batch's bars of a symbol
are taken in time order. What leaves is what the batch kernel gives for these bars, row by row and with
the same numbers; a bar with ``ended`` is the run's last, after which the symbol starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, fields

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerline.operators.backtest import TAGGED, kernel_bars, rows_of, tagged_rows
from ledgerline.operators.kernels import Bars, Config, Position, Run, resume

#: A bar that isn't after the last one of its symbol; it changes nothing.
LATE = "LATE_BAR"
BAR = "date string, at long, day long, open double, low double, close double, ema20 double, atr14 double, long boolean"
RUN = "cash double, trades long, bars long, held boolean, signal_date string, entry_date string, entry_day long, reference double, price double, stop double, atr double, quantity long, budget double, leaving boolean"
_BAR = [c.split()[0] for c in BAR.split(", ")]
_NOBODY = (None, None, None, None, None, None, None, None, None, None)


def _packed(run: Run) -> tuple:
    return (float(run.cash), int(run.trades), int(run.bars), run.held is not None, *(astuple(run.held) if run.held else _NOBODY))


def _unpacked(row: tuple) -> Run:
    cash, trades, bars, held, *position = row
    kinds = (str, str, int, float, float, float, float, int, float, bool)
    return Run(cash, Position(*(k(x) for k, x in zip(kinds, position))) if held else None, trades, bars)


class Runs(StatefulProcessor):
    def __init__(self, configs: dict[str, Config]):
        self.configs = configs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "run_id string", RUN)
        self.last = handle.getValueState("last", BAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable")
        waiting = self.last.get() if self.last.exists() else None
        on_time = bars["at"].diff().fillna(1) > 0
        if waiting is not None:
            on_time &= bars["at"] > waiting[1]
        out = [*self._late(key[0], bars[~on_time])]
        bars = bars[on_time]
        ends = [k + 1 for k, e in enumerate(bars["ended"]) if e]
        for a, b in zip([0, *ends], [*ends, len(bars)]):
            if b > a:
                out += self._part(key[0], bars.iloc[a:b][_BAR], waiting, b in ends)
                waiting = None
        if out:
            yield pa.concat_tables(out).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    def _part(self, symbol: str, bars: pd.DataFrame, waiting, ended: bool) -> Iterator[pa.Table]:
        columns = bars.to_dict("list")
        if waiting is not None:
            columns = {c: [waiting[k], *columns[c]] for k, c in enumerate(_BAR)}
        own = Bars(*(columns[f.name] for f in fields(Bars)))
        for run_id, config in self.configs.items():
            run = _unpacked(self.runs.getValue((run_id,))) if self.runs.containsKey((run_id,)) else Run(config.initial_capital)
            first = run.bars
            yield from rows_of(resume(run, own, config, ended), own, first, (symbol, run_id, config.initial_capital))
            if ended:
                self.runs.removeKey((run_id,))
            else:
                self.runs.updateValue((run_id,), _packed(run))
        if ended:
            self.last.clear()
        else:
            self.last.update(tuple(columns[c][-1] for c in _BAR))

    def _late(self, symbol: str, bars: pd.DataFrame) -> Iterator[pa.Table]:
        what = [bars["date"].tolist(), [LATE] * len(bars), ["not after the last bar"] * len(bars)]
        for run_id, config in self.configs.items() if len(bars) else ():
            yield tagged_rows("skip", what, [-2] * len(bars), symbol, run_id, config.initial_capital)

    def close(self) -> None:
        pass


def continued_runs(table: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """Tagged rows of ``configs`` over a stream of feature rows with signal and ``ended``. Rows without
    a symbol or a date are no bars."""
    bars = kernel_bars(table.where("symbol is not null and date is not null"), "ended")
    return bars.groupBy("symbol").transformWithStateInPandas(Runs(configs), T.StructType.fromDDL(TAGGED), "Append", "None")


#: What the state needs of a session.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def advanced(spark: SparkSession, parts: str, schema: T.StructType, where: str, configs: dict[str, Config]) -> DataFrame:
    """The tagged rows so far of a folder of Parquet parts. What was added to it since the last call is one
    micro-batch; ``where`` holds results, progress and state, so a call goes on where the last ended."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        rows = continued_runs(spark.readStream.schema(schema).parquet(parts), configs)
        query = rows.writeStream.option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start(f"{where}/rows", format="parquet")
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return spark.read.schema(T.StructType.fromDDL(TAGGED)).parquet(f"{where}/rows")
