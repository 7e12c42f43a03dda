"""python -m ledgerline data|signals|backtest|validate --root DIR [--symbol S | --symbols S...]"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerline")
    p.add_argument("plan", choices=("data", "signals", "backtest", "validate"))
    p.add_argument("--root", required=True)
    which = p.add_mutually_exclusive_group()
    which.add_argument("--symbol", default=None)
    which.add_argument("--symbols", nargs="+", default=None)
    p.add_argument("--format", choices=("parquet", "csv"), default="parquet", help="of bars and features")
    p.add_argument("--spread", action="store_true", help="signals: spread each symbol's bars over tasks")
    p.add_argument("--capital", type=float, default=100_000.0)
    p.add_argument("--risk-per-trade", type=float, default=0.01)
    p.add_argument("--slippage", type=float, default=0.0005)
    p.add_argument("--commission", type=float, default=0.0005)
    p.add_argument("--atr-multiplier", type=float, default=2.0)
    p.add_argument("--initial-dev-years", type=int, default=3)
    p.add_argument("--step-months", type=int, default=6)
    p.add_argument("--test-months", type=int, default=6)
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    from ledgerline.plans import pipelines

    a = parser().parse_args(args)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("ledgerline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    symbols = a.symbols or [a.symbol or pipelines.DEFAULT[0]]
    if a.plan == "data":
        out = pipelines.data(spark, a.root, symbols, fmt=a.format)
    elif a.plan == "signals":
        out = pipelines.signals(spark, a.root, symbols, fmt=a.format, spread=a.spread)
    elif a.plan == "backtest":
        out = pipelines.backtests(spark, a.root, symbols, a.capital, a.risk_per_trade, a.slippage, a.commission, a.atr_multiplier, a.format)
    else:
        out = pipelines.validate(spark, a.root, symbols, a.initial_dev_years, a.step_months, a.test_months, fmt=a.format)
    for name, status in sorted(out.status.items()):
        print(f"{name}: {status}")
    return 0 if out.ok else 1


if __name__ == "__main__":
    sys.exit(main())
