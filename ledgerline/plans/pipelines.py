"""End-to-end plans: raw files to bars, bars to signals, signals to backtests, and validation.

All symbols of a call run in one job partitioned by symbol, and their files are one scan; what the driver has
of them is a row per file. Tables between steps are Parquet, partitioned by symbol.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import sinks
from ledgerline.operators import backtest, clean, features, metrics, quality, query, validation
from ledgerline.operators import spread as scans
from ledgerline.operators.kernels import Config
from ledgerline.schemas import SIGNAL_COLUMNS
from ledgerline.sources import catalog as symbols_
from ledgerline.sources import vendor
from ledgerline.sources.files import bars_table, features_table, read_artifact, read_table, signals_only

DEFAULT = ("ITC",)


@dataclass
class Outcome:
    """What a plan wrote, the statuses by symbol, and whether all is well."""

    written: list[str] = field(default_factory=list)
    status: dict[str, str] = field(default_factory=dict)
    ok: bool = True


def _keys(symbols) -> list[str]:
    names = [symbols] if isinstance(symbols, str) else list(symbols)
    return [s.upper() for s in names]


def data(spark: SparkSession, root: str, symbols=DEFAULT, known=symbols_.SYMBOLS, fmt: str = "parquet") -> Outcome:
    """Raw vendor files to canonical bars, issues and quality reports; a FAIL makes it not ok."""
    out = Outcome()
    raw = vendor.scan_all(spark, {s: symbols_.paths(root, s, known)["raw"] for s in _keys(symbols)})
    told = raw.reports.collect()  # a row per file
    if lacking := [f"{r.path}: {'; '.join(r.errors)}" for r in told if r.errors]:
        raise ValueError("; ".join(lacking))
    about = {r.symbol: (r.path.rsplit("/", 1)[-1], r.sha256, *clean.absent(r.columns)) for r in told}
    c = clean.clean(raw.rows)
    bars = c.bars.persist()
    out.written.append(f"{root}/processed/stocks")
    sinks.write_bars(bars, out.written[-1], fmt)
    c.issues.write.mode("overwrite").partitionBy("symbol").parquet(f"{root}/reports/issues")
    notes = quality.notes(spark, {s: (warnings, errors) for s, (_, _, warnings, errors) in about.items()})
    files = spark.createDataFrame([(s, name, digest) for s, (name, digest, *_) in about.items()], "symbol string, source_filename string, sha256 string")
    report = quality.report(bars, notes).join(c.counts, "symbol").join(F.broadcast(files), "symbol")  # a row per symbol asked for
    report = report.persist()
    sinks.write_json(report, f"{root}/reports/quality")
    # Not by symbol: a table without rows then still has a file with its columns.
    broken = {"quality_ohlc": quality.violation_rows(bars), "quality_change": quality.mismatch_rows(bars)}
    for name, rows in broken.items():
        rows.write.mode("overwrite").parquet(f"{root}/reports/{name}")
    out.status = {r.symbol: r.status for r in report.select("symbol", "status").collect()}
    sinks.write_document(sinks.quality_markdown(report, *broken.values()), f"{root}/reports/quality_markdown")
    out.written += [f"{root}/reports/{n}" for n in ("issues", "quality", *broken, "quality_markdown")]
    out.ok = quality.FAIL not in out.status.values() and not vendor.changed(spark, raw.reports)
    bars.unpersist()
    report.unpersist()
    return out


def _of(df: DataFrame, symbols) -> DataFrame:
    """Partition pruning keeps other symbols' files unread."""
    return df.where(F.col("symbol").isin(_keys(symbols)))


def signals(spark: SparkSession, root: str, symbols=DEFAULT, fmt: str = "parquet", spread: bool = False) -> Outcome:
    """spread: for symbols with more bars than one task should read, features by scans over chunks."""
    bars = _of(bars_table(spark, f"{root}/processed/stocks", fmt), symbols)
    table = features.signals(scans.features(bars)).select(*SIGNAL_COLUMNS) if spread else features.signal_table(bars)
    path = f"{root}/features/stocks"
    sinks.write_features(table, path, fmt, spread)
    kept = signals_only(spark, path, fmt)
    return Outcome([path], {r.symbol: f"{r.n_long} LONG" for r in features.signal_summary(kept).collect()})


def backtests(spark: SparkSession, root: str, symbols=DEFAULT, capital: float = 100_000.0, risk_per_trade: float = 0.01, slippage: float = 0.0005, commission: float = 0.0005, atr_multiplier: float = 2.0, fmt: str = "parquet") -> Outcome:
    configs = {validation.FULL: Config(capital, risk_per_trade, atr_multiplier, slippage, commission)}
    tagged = backtest.run_backtests(_of(features_table(spark, f"{root}/features/stocks", fmt), symbols), configs).persist()
    where = f"{root}/backtests"
    sinks.write_csv(sinks.trade_rows(backtest.trades(tagged)), f"{where}/trades")
    curve = backtest.equity(tagged)
    sinks.write_csv(curve.select("symbol", *sinks.equity_columns()), f"{where}/equity")
    backtest.skips(tagged).write.mode("overwrite").parquet(f"{where}/skips")
    summary = metrics.with_counts_and_config(metrics.metrics(tagged), tagged, backtest.config_table(spark, configs)).persist()
    sinks.write_json(summary, f"{where}/summary")
    sinks.write_document(sinks.backtest_markdown(summary), f"{where}/markdown")
    out = Outcome([f"{where}/{n}" for n in ("trades", "equity", "skips", "summary", "markdown")], {r.symbol: f"{r.num_trades} trades" for r in summary.select("symbol", "num_trades").collect()})
    tagged.unpersist()
    summary.unpersist()
    return out


def validate(spark: SparkSession, root: str, symbols=DEFAULT, initial_dev_years: int = 3, step_months: int = 6, test_months: int = 6, config: Config = Config(), fmt: str = "parquet") -> Outcome:  # noqa: B008
    """The full run, the windows and the grid in one pass over the bars, and what follows from them."""
    table = _of(features_table(spark, f"{root}/features/stocks", fmt), symbols)
    windows = validation.splits(table, initial_dev_years, step_months, test_months).persist()
    done = validation.all_runs(table, windows, config).persist()  # a row per symbol and run
    walked, points, full = validation.walk_of(done, windows, config), validation.points_of(done, config), validation.full_of(done)
    rolled, held = validation.rollup(walked), validation.buy_hold(table, config=config)
    where, out = f"{root}/validation", Outcome()
    for name, df in {"splits": sinks.splits_json(windows), "walkforward": sinks.walk_forward_json(walked), "sensitivity": sinks.sensitivity_json(points), "windows": walked, "points": points}.items():
        df.write.mode("overwrite").parquet(f"{where}/{name}")
        out.written.append(f"{where}/{name}")
    gates = validation.gate_violations(walked, points, full)
    summary = rolled.join(held.select("symbol", F.struct(*(c for c in held.columns if c != "symbol")).alias("buy_and_hold")), "symbol").join(gates.groupBy("symbol").agg(F.sum("violations").alias("gate_violations")), "symbol", "left")
    sinks.write_json(summary, f"{where}/summary")
    sinks.write_document(sinks.validation_markdown(rolled, walked, points), f"{where}/markdown")
    out.written += [f"{where}/summary", f"{where}/markdown"]
    try:
        validation.check_gates(gates)
        out.status = {"gates": "PASSED"}
    except validation.IntegrityError as e:
        out.status, out.ok = {"gates": str(e)}, False
    windows.unpersist()
    done.unpersist()
    return out


def context(spark: SparkSession, root: str) -> DataFrame:
    """The research context of all symbols, from what the plans wrote; what is missing or broken of it counts
    as absent, for its symbol or, a table's file, for its rows."""
    said = {"backtest summary": "backtests/summary", "data quality report": "reports/quality", "walk-forward summary": "validation/summary"}
    read: dict[str, DataFrame | None] = {name: read_artifact(spark, f"{root}/{path}") for name, path in said.items()}
    walked = read_table(spark, f"{root}/validation/windows")
    read["walk-forward windows"] = None if walked is None else query.narrow_windows(walked)
    read["sensitivity"] = read_table(spark, f"{root}/validation/points")
    return query.research_context(read)
