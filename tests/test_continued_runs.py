"""Runs that new bars continue are the runs over all bars."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import backtest, features
from ledgerline.operators.kernels import Bars, Config, Run, resume, simulate
from ledgerline.streaming.runs import LATE, advanced


def bars_of(seed, n=160):
    r = random.Random(seed)
    close = [100.0]
    for _ in range(n - 1):
        close.append(max(1.0, close[-1] * (1 + r.gauss(0, 0.03))))
    return Bars([f"2020-{k:04d}" for k in range(n)], list(range(n)), [c * (1 + r.gauss(0, 0.01)) for c in close], [c * 0.97 for c in close], close, [c * (1 + r.gauss(0, 0.02)) for c in close], [r.choice([2.0, 1.0, float("nan")]) for _ in close], [r.random() < 0.2 for _ in close])


@pytest.mark.parametrize("seed", range(20))
def test_parts_of_any_size_give_the_whole_run(seed):
    bars, config, r = bars_of(seed), Config(), random.Random(seed)
    whole = simulate(bars, config)
    run, trades, skips, cash, quantity, at, start = Run(config.initial_capital), [], [], [], [], [], 0
    while start < len(bars.close):
        end = min(len(bars.close), start + r.randrange(1, 40))
        part = bars.part(max(0, run.bars), end)  # the waiting bar and the new ones
        done = resume(run, part, config, end == len(bars.close))
        trades += done.trades
        skips += done.skips
        at += done.trade_at
        cash += done.cash.tolist()
        quantity += done.quantity.tolist()
        start = end
    assert trades == whole.trades and skips == whole.skips and at == whole.trade_at
    assert cash == whole.cash.tolist() and quantity == whole.quantity.tolist() and whole.trades


def table(spark):
    r = np.random.default_rng(2)
    rows = []
    for s in ("A", "B"):
        close = 100 * np.exp(np.cumsum(r.normal(0, 0.03, 120)))
        rows += [(s, f"2021-{1 + k // 28:02d}-{1 + k % 28:02d}", float(c), float(c * 0.98), float(c), float(c * (1 + r.normal(0, 0.02))), 2.0, "LONG" if r.random() < 0.2 else features.NO_SIGNAL) for k, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, date string, open double, low double, close double, ema20 double, atr14 double, signal string").withColumn("date", F.col("date").cast("date")).withColumn("high", F.col("open") + 1)


def test_a_stream_in_parts_gives_the_batch(spark, tmp_path):
    whole = table(spark)
    configs = {"full": Config(), "other": Config(50_000.0, 0.02, 3.0)}
    marked = whole.withColumn("ended", F.col("date") == F.lit("2021-05-08").cast("date"))
    steps = ["2021-01-01", "2021-01-02", "2021-02-20", "2022-01-01"]
    got = None
    for low, high in zip(steps[:-1], steps[1:]):  # each call goes on where the last ended
        part = marked.where((F.col("date") >= low) & (F.col("date") < high))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/parts")
        got = advanced(spark, f"{tmp_path}/parts", marked.schema, str(tmp_path), configs)
    want = backtest.run_backtests(whole, configs)
    for pick in (backtest.trades, backtest.equity, backtest.skips):
        a, b = (sorted(map(tuple, pick(t).collect()), key=str) for t in (got, want))
        assert a == b and a
    order = lambda t: sorted((r.symbol, r.run_id, r.seq, r.kind) for r in t.where("kind <> 'span'").collect())
    assert order(got) == order(want)


def test_late_bars_change_nothing_and_are_told(spark, tmp_path):
    whole = table(spark).where("symbol = 'A'").withColumn("ended", F.lit(False))
    first = whole.where("date < '2021-03-01'")
    first.coalesce(1).write.parquet(f"{tmp_path}/parts")
    run = lambda: advanced(spark, f"{tmp_path}/parts", whole.schema, str(tmp_path), {"full": Config()})
    before = sorted(map(str, run().collect()))
    whole.where("date = '2021-02-10'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/parts")
    after = run()
    assert [r.skip.signal_date for r in after.where(f"skip.reason = '{LATE}'").collect()] == ["2021-02-10"]
    assert sorted(map(str, after.where(f"kind <> 'skip' or skip.reason <> '{LATE}'").collect())) == before
