"""The engine's queries by name: each takes (spark, folder of tables) and returns a DataFrame.

Every query gives dates as ISO text and numbers rounded half up to six digits (metrics: four), so
that results compare across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import sinks
from ledgerline.functions import parse
from ledgerline.functions.indicators import by_symbol, with_windowed
from ledgerline.functions.parse import rounded
from ledgerline.operators import backtest, clean, features, metrics, quality, query, spread, validation
from ledgerline.operators.kernels import Config
from ledgerline.operators.scan import shared_folder, written
from ledgerline.plans import files
from ledgerline.schemas import CONDITIONS, FEATURE_COLUMNS
from ledgerline.sources.bars import bars_events, bars_orders, raw_events
from ledgerline.streaming import runs

#: A range of days and a symbol that the test tables have at every scale.
SYMBOL, LOW, HIGH = "click", "2024-01-05", "2024-01-20"


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text, doubles rounded."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((c.cast("string") if kind.startswith(("date", "timestamp")) else rounded(c, digits) if kind == "double" else c.cast("long") if kind == "int" else c).alias(f.name))
    return df.select(*out)


def _windowed(*columns: str):
    return lambda spark, d: plain(with_windowed(bars_events(spark, d)).select("symbol", "date", *columns))


def _signals(spark: SparkSession, d: str, orders: bool = False) -> DataFrame:
    return features.signals(features.features(bars_orders(spark, d) if orders else bars_events(spark, d)))


#: A run over all bars with the default configuration, and one with another.
FULL = {validation.FULL: Config()}
OTHER = Config(50_000.0, 0.02, 3.0, 0.001, 0.002)


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return backtest.run_backtests(_signals(spark, d), FULL)


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return backtest.trades(_tagged(spark, d))


def trades(spark: SparkSession, d: str) -> DataFrame:
    return plain(_trades(spark, d), 4)


def _cleaned(spark: SparkSession, d: str) -> clean.Cleaned:
    return clean.clean(raw_events(spark, d))


def _parse(column: str, name: str, fn):
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = F.col(f"`{column}`")
        return plain(raw_events(spark, d).select("_src_row", c.alias("raw"), fn(c).alias(name)))

    return run


def bars(spark: SparkSession, d: str) -> DataFrame:
    return plain(bars_events(spark, d))


def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    return plain(bars_orders(spark, d))


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    return plain(features.features(bars_events(spark, d)).select("symbol", "date", *FEATURE_COLUMNS))


def breakouts(spark: SparkSession, d: str) -> DataFrame:
    """Bars whose close passes the previous high on high volume: built-in operators alone."""
    t = with_windowed(bars_events(spark, d))
    hit = (F.col("close") > F.col("previous_high_20")) & (F.col("volume_ratio") > features.VOLUME_FACTOR)
    return plain(t.where(hit).select("symbol", "date", "close", "sma20", "previous_high_20", "volume_ratio"))


#: Chunks of the scans, so that symbols go over their ends at every scale.
CHUNKS = 8


def _spread(*columns: str):
    """Features by scans over chunks of bars."""
    return lambda spark, d: plain(spread.features(bars_events(spark, d), partitions=CHUNKS).select("symbol", "date", *columns))


def drawdown_spread(spark: SparkSession, d: str) -> DataFrame:
    return plain(spread.drawdown(backtest.equity(_tagged(spark, d)), CHUNKS).select("symbol", "date", "equity", "peak", "drawdown"), 4)


def metrics_spread(spark: SparkSession, d: str) -> DataFrame:
    return plain(metrics.metrics(_tagged(spark, d), lambda t: spread.peaked(t, CHUNKS)), 4)


def q_status_spread(spark: SparkSession, d: str) -> DataFrame:
    return plain(quality.report(_cleaned(spark, d).bars, stepped=lambda b: spread.stepped(b, CHUNKS)).select(*STATUS))


def q_change_spread(spark: SparkSession, d: str) -> DataFrame:
    done = spread.stepped(_cleaned(spark, d).bars, CHUNKS)
    return plain(done.where(F.col("difference") > quality.TOLERANCE).select("symbol", "_src_row", "date", "computed", "difference"))


def _continued(spark: SparkSession, d: str) -> DataFrame:
    """The tagged rows of a run that is continued twice: bars before LOW, before HIGH, and the rest."""
    table = _signals(spark, d)
    last = table.groupBy("symbol").agg(F.max("date").alias("last"))
    marked = written(table.join(last, "symbol").withColumn("ended", F.col("date") == F.col("last")).drop("last"))
    where, done = shared_folder(spark), None
    for part in (F.col("date") < LOW, (F.col("date") >= LOW) & (F.col("date") < HIGH), F.col("date") >= HIGH):
        marked.where(part).write.mode("append").parquet(f"{where}/parts")
        done = runs.advanced(spark, f"{where}/parts", marked.schema, where, FULL)
    return done


def conditions(spark: SparkSession, d: str) -> DataFrame:
    return plain(_signals(spark, d).select("symbol", "date", *CONDITIONS))


def signal(spark: SparkSession, d: str) -> DataFrame:
    return plain(_signals(spark, d).select("symbol", "date", "close", "signal"))


def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return clean.distinct_rows(clean.prepared(raw_events(spark, d), None)).select("symbol", "_src_row")


def dedup_date(spark: SparkSession, d: str) -> DataFrame:
    return plain(_cleaned(spark, d).bars)


def q_ohlc(spark: SparkSession, d: str) -> DataFrame:
    return plain(quality.ohlc_violations(_cleaned(spark, d).bars).select("symbol", "_src_row", F.array_join("violated_rules", ",").alias("rules")))


def q_missing(spark: SparkSession, d: str) -> DataFrame:
    m = quality.missing_counts(_cleaned(spark, d).bars)
    return m.select("symbol", *(F.col("missing_counts")[c].alias(c) for c in ("date", "open", "high", "low", "close", "volume")))


def q_change_pct(spark: SparkSession, d: str) -> DataFrame:
    return plain(quality.change_mismatches(_cleaned(spark, d).bars).select("symbol", "_src_row", "date", "computed", "difference"))


STATUS = ("symbol", "rows", "invalid_dates", "date_min", "date_max", "missing", "zero", "negative", "n_ohlc", "n_backward", "n_change", "status")


def q_status(spark: SparkSession, d: str) -> DataFrame:
    return plain(quality.report(_cleaned(spark, d).bars).select(*STATUS))


def q_drift(spark: SparkSession, d: str) -> DataFrame:
    """The report of a source without volumes and with a column too many: warnings, and their status."""
    done = clean.clean(raw_events(spark, d).drop("Vol."))
    told = lambda x, name: F.array(*map(F.lit, x)).cast("array<string>").alias(name)
    about = done.counts.select("symbol", told(done.warnings, "cleaning_warnings"), told(done.errors, "cleaning_errors"))
    text = [F.array_join(c, "; ").alias(c) for c in ("missing_columns", "unexpected_columns", "cleaning_warnings", "cleaning_errors")]
    return plain(quality.report(done.bars.withColumn("note", F.lit("x")), about).select("symbol", "rows", "missing", *text, "status"))


def q_lacking(spark: SparkSession, d: str) -> DataFrame:
    """The report of bars without two canonical columns."""
    done = quality.report(_cleaned(spark, d).bars.drop("volume", "open"))
    text = F.array_join("missing_columns", "; ").alias("missing_columns")
    counts = [F.col("missing_counts")[c].alias(f"missing_{c}") for c in ("open", "close", "volume")]
    return plain(done.select("symbol", "rows", text, *counts, "n_ohlc", "status"))


def q_report(spark: SparkSession, d: str) -> DataFrame:
    """The reader's view of the whole report."""
    done = _cleaned(spark, d)
    view = query.quality_view(quality.report(done.bars).join(done.counts, "symbol"))
    return plain(view.withColumn("missing_close", F.col("missing_counts")["close"]).drop("missing_counts"))


def q_monotonic(spark: SparkSession, d: str) -> DataFrame:
    return quality.backward_dates(clean.parsed(clean.prepared(raw_events(spark, d), None)))


def summary(spark: SparkSession, d: str) -> DataFrame:
    return plain(metrics.metrics(_tagged(spark, d)), 4)


def exit_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.map_rows(metrics.reason_map(_trades(spark, d), "exit_reason", "counts"), "counts")


def skip_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.reason_counts(backtest.skips(_tagged(spark, d)), "reason")


def drawdown(spark: SparkSession, d: str) -> DataFrame:
    return plain(metrics.drawdown(backtest.equity(_tagged(spark, d))).select("symbol", "date", "equity", "peak", "drawdown"), 4)


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return validation.splits(bars_orders(spark, d))


def splits(spark: SparkSession, d: str) -> DataFrame:
    return plain(_windows(spark, d).drop("low", "high"))


def _walked(spark: SparkSession, d: str) -> DataFrame:
    return validation.walk_forward(_signals(spark, d, orders=True), _windows(spark, d))


def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return plain(_walked(spark, d), 4)


def wf_rollup(spark: SparkSession, d: str) -> DataFrame:
    return plain(validation.rollup(_walked(spark, d)), 4)


def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return plain(validation.sensitivity(_signals(spark, d)), 4)


def _all_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(walked, points, full) of one pass over the bars."""
    windows = _windows(spark, d)
    done = validation.all_runs(_signals(spark, d, orders=True), windows)
    return validation.walk_of(done, windows), validation.points_of(done), validation.full_of(done)


def gates(spark: SparkSession, d: str) -> DataFrame:
    return validation.gate_violations(*_all_runs(spark, d))


def gates_broken(spark: SparkSession, d: str) -> DataFrame:
    """The gates over windows and grid points that were made to break each of them."""
    walked, points, full = _all_runs(spark, d)
    k, own = F.col("window_index") % 6, F.col("symbol")
    walked = walked.withColumns({
        "dev_end": F.when(k == 1, F.col("test_start")).otherwise(F.col("dev_end")),
        "test_start": F.when(k == 2, F.lit("1999-01-01").cast("date")).otherwise(F.col("test_start")),
        "symbol": F.when(k == 3, F.lit(None).cast("string")).when(k == 4, F.lit("OTHER")).otherwise(own),
        "final_equity": F.when(k == 5, F.lit(-1.0)).otherwise(F.col("final_equity")),
        "max_drawdown_pct": F.when(k == 0, F.lit(5.0)).otherwise(F.col("max_drawdown_pct")),
    })
    points = points.withColumns({
        "is_baseline": F.col("is_baseline") & (own != "1-URGENT"),
        "num_trades": F.col("num_trades") + F.when(own == "2-HIGH", 1).otherwise(0),
    })
    return validation.gate_violations(walked, points, full)


def metrics_other(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of a run with every parameter overridden."""
    return plain(metrics.metrics(backtest.run_backtests(_signals(spark, d), {"other": OTHER})), 4)


def config_echo(spark: SparkSession, d: str) -> DataFrame:
    """What a summary says of its exits, its skipped signals and its configuration."""
    configs = {"other": OTHER}
    tagged = backtest.run_backtests(_signals(spark, d), configs)
    whole = metrics.with_counts_and_config(metrics.metrics(tagged), tagged, backtest.config_table(spark, configs))
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return plain(whole.select("symbol", total("exit_reason_counts").alias("n_exits"), total("skip_reason_counts").alias("n_skips"), "backtest_config.*"), 4)


def grid(spark: SparkSession, d: str) -> DataFrame:
    return validation.grid_runs(bars_events(spark, d))


def transaction_cost(spark: SparkSession, d: str) -> DataFrame:
    c = backtest.total_transaction_cost(F.col("entry_price"), F.col("exit_price"), F.col("quantity"), F.lit(FULL[validation.FULL].commission_rate))
    return plain(_trades(spark, d).select("symbol", "trade_id", c.alias("cost")), 4)


def holding(spark: SparkSession, d: str) -> DataFrame:
    days = parse.days_between(F.to_date("entry_date"), F.to_date("exit_date"))
    return plain(_trades(spark, d).select("symbol", "trade_id", days.alias("days")))


CUT = "1996-01-01"


def slice_dev(spark: SparkSession, d: str) -> DataFrame:
    return plain(validation.slice_dev(bars_orders(spark, d), F.lit(CUT).cast("date")))


def slice_test(spark: SparkSession, d: str) -> DataFrame:
    return plain(validation.slice_test(bars_orders(spark, d), F.lit(CUT).cast("date"), F.lit("1996-06-30").cast("date")))


def catalog_table(spark: SparkSession, d: str) -> DataFrame:
    return files.catalog_of(spark, d)


def context_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of the research context, one row each again."""
    narrow = query.narrow_windows(_walked(spark, d))
    return plain(narrow.select("symbol", "total_windows", "ok_windows", F.explode("windows_summary").alias("w")).select("symbol", "total_windows", "ok_windows", "w.*"), 4)


def context_sources(spark: SparkSession, d: str) -> DataFrame:
    """Which artifacts the research context has of each symbol, and how many rows of each."""
    walked = _walked(spark, d)
    made = {"walk-forward summary": validation.rollup(walked), "walk-forward windows": walked, "nothing": None}
    return query.research_context(made).select("symbol", F.col("place").cast("long").alias("place"), "source", F.json_array_length("text").cast("long").alias("n"))


def json_windows(spark: SparkSession, d: str) -> DataFrame:
    """The walk-forward document of each symbol, read again."""
    doc = sinks.walk_forward_json(_walked(spark, d))
    part = F.from_json("json", "total_windows long, ok_windows long, windows array<struct<window_index:long,status:string,strategy:struct<num_trades:long,total_return_pct:double>,excess_return_pct:double>>")
    read = doc.select("symbol", part.alias("j")).select("symbol", "j.total_windows", "j.ok_windows", F.explode("j.windows").alias("w"))
    return plain(read.select("symbol", "total_windows", "ok_windows", "w.window_index", "w.status", "w.strategy.num_trades", "w.strategy.total_return_pct", "w.excess_return_pct"), 4)


def json_splits(spark: SparkSession, d: str) -> DataFrame:
    doc = sinks.splits_json(_windows(spark, d))
    part = F.from_json("json", "total_windows long, windows array<struct<window_index:long,dev_rows:long,test_rows:long,status:string>>")
    return doc.select("symbol", part.alias("j")).select("symbol", "j.total_windows", F.explode("j.windows").alias("w")).select("symbol", "total_windows", "w.*")


def json_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    doc = sinks.sensitivity_json(validation.sensitivity(_signals(spark, d)))
    part = F.explode(F.from_json("json", "array<struct<param_name:string,param_value:double,is_baseline:boolean,num_trades:long,final_equity:double>>"))
    return plain(doc.select("symbol", part.alias("p")).select("symbol", "p.*"), 4)


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of the validation report stand under each of its headings."""
    walked = _walked(spark, d)
    doc = sinks.validation_markdown(validation.rollup(walked), walked, validation.sensitivity(_signals(spark, d, orders=True)))
    line = F.explode(F.split("value", "\n"))
    rows = doc.select("symbol", line.alias("line")).where(F.col("line").startswith("| ") & ~F.col("line").rlike("^\\| (window_index|param_name|total_windows) "))
    return rows.groupBy("symbol").agg(F.count("*").alias("n"))


def sink_trades(spark: SparkSession, d: str) -> DataFrame:
    return plain(sinks.trade_rows(_trades(spark, d)).select("symbol", "trade_id", "entry_price", "initial_stop", "net_pnl", "return_pct"), 4)


def sink_equity(spark: SparkSession, d: str) -> DataFrame:
    return plain(backtest.equity(_tagged(spark, d)).select("symbol", *sinks.equity_columns()), 4)


def lookup(spark: SparkSession, d: str) -> DataFrame:
    """A symbol's summary, asked for in small letters."""
    done = metrics.metrics(_tagged(spark, d)).withColumn("symbol", parse.symbol_key(F.col("symbol")))
    return plain(query.lookup(done, SYMBOL).select("symbol", "num_trades", "final_equity"), 4)


def overview(spark: SparkSession, d: str) -> DataFrame:
    table = _signals(spark, d)
    done = metrics.metrics(backtest.run_backtests(table, FULL)).select("symbol", "final_equity", "total_return_pct", "num_trades", "win_rate")
    return plain(query.overview(table, done), 4)


def available_symbols(spark: SparkSession, d: str) -> DataFrame:
    catalog = spark.createDataFrame([("click",), ("purchase",), ("nothing",)], "symbol string")
    from ledgerline.sources.catalog import available

    return available(bars_events(spark, d), catalog)


def trade_next_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page, from the last row of the second, and that from the last row of the first."""
    ledger, last = written(_trades(spark, d)), None
    for _ in range(2):
        page = query.page_after(ledger, "net_pnl", False, last, 10).collect()  # a page
        last = query.sort_key(page[-1], "net_pnl") if page else last
    return plain(query.page_after(ledger, "net_pnl", False, last, 10).select("symbol", "trade_id", "net_pnl"), 4)


def queries() -> dict:
    issues = lambda s, d: _cleaned(s, d).issues
    return files.queries(plain, gates_broken) | {
        "breakouts": breakouts,
        "bars_events": bars,
        "bars_orders": daily_bars,
        "parse_volume": _parse("Vol.", "volume", parse.parse_volume),
        "parse_pct": _parse("Change %", "change", parse.parse_change_pct),
        "parse_date": _parse("Date", "date", parse.parse_date),
        "parse_price": _parse("Price", "price", parse.parse_price),
        "dedup_exact": dedup_exact,
        "dedup_date": dedup_date,
        "clean_counts": lambda s, d: _cleaned(s, d).counts.drop("n_issues"),
        "clean_issues": issues,
        "q_missing": q_missing,
        "q_ohlc": q_ohlc,
        "q_volume": lambda s, d: quality.volume_counts(_cleaned(s, d).bars),
        "q_monotonic": q_monotonic,
        "q_change_pct": q_change_pct,
        "q_status": q_status,
        "q_drift": q_drift,
        "q_lacking": q_lacking,
        "q_report": q_report,
        "sma": _windowed("sma20", "sma50"),
        "true_range": _windowed("true_range"),
        "avg_volume": _windowed("avg_volume_20"),
        "volume_ratio": _windowed("volume_ratio"),
        "momentum": _windowed("momentum_5", "momentum_20"),
        "prev_high_20": _windowed("previous_high_20"),
        "ema": lambda s, d: plain(features.features(bars_events(s, d)).select("symbol", "date", "ema20", "ema50")),
        "atr": lambda s, d: plain(features.features(bars_events(s, d)).select("symbol", "date", "atr14")),
        "features": feature_table,
        "ema_spread": _spread("ema20", "ema50"),
        "atr_spread": _spread("true_range", "atr14"),
        "windows_spread": _spread("sma20", "sma50", "avg_volume_20", "volume_ratio", "momentum_5", "momentum_20", "previous_high_20"),
        "drawdown_spread": drawdown_spread,
        "metrics_spread": metrics_spread,
        "q_status_spread": q_status_spread,
        "q_change_spread": q_change_spread,
        "trades_continued": lambda s, d: plain(backtest.trades(_continued(s, d)), 4),
        "equity_continued": lambda s, d: plain(backtest.equity(_continued(s, d)), 4),
        "conditions": conditions,
        "signal": signal,
        "signal_summary": lambda s, d: plain(features.signal_summary(_signals(s, d))),
        "trades": trades,
        "equity": lambda s, d: plain(backtest.equity(_tagged(s, d)), 4),
        "skips": lambda s, d: backtest.skips(_tagged(s, d)).select("symbol", "signal_date", "reason"),
        "metrics": summary,
        "drawdown": drawdown,
        "exit_counts": exit_counts,
        "skip_counts": skip_counts,
        "buy_hold": lambda s, d: plain(validation.buy_hold(bars_events(s, d)), 4),
        "splits": splits,
        "walk_forward": walk_forward,
        "wf_rollup": wf_rollup,
        "sensitivity": sensitivity,
        "gates": gates,
        "gates_broken": gates_broken,
        "metrics_other": metrics_other,
        "config_echo": config_echo,
        "grid": grid,
        "transaction_cost": transaction_cost,
        "holding": holding,
        "slice_dev": slice_dev,
        "slice_test": slice_test,
        "catalog": catalog_table,
        "context_windows": context_windows,
        "context_sources": context_sources,
        "json_windows": json_windows,
        "json_splits": json_splits,
        "json_sensitivity": json_sensitivity,
        "report_lines": report_lines,
        "sink_trades": sink_trades,
        "sink_equity": sink_equity,
        "lookup": lookup,
        "ohlcv_range": lambda s, d: plain(query.ohlcv(bars_events(s, d), SYMBOL, LOW, HIGH)),
        "features_range": lambda s, d: plain(query.feature_range(_signals(s, d), SYMBOL, LOW, HIGH)),
        "overview": overview,
        "available_symbols": available_symbols,
        "trade_search": lambda s, d: query.search_trades(_trades(s, d), "2024-01-1", "STOP_LOSS").select("symbol", "trade_id", "exit_date", "exit_reason"),
        "trade_sort": lambda s, d: plain(query.sort_trades(_trades(s, d), "net_pnl", False).select("symbol", "trade_id", "net_pnl"), 4),
        "trade_page": lambda s, d: query.page(query.sort_trades(_trades(s, d), "entry_date"), 2, 10).select("symbol", "trade_id", "entry_date"),
        "trade_next_page": trade_next_page,
        "distinct_exit": lambda s, d: query.exit_reasons(_trades(s, d)),
        "downsample": lambda s, d: plain(query.downsample(bars_events(s, d), 500).select("symbol", "date", "close")),
        "downsample_volume": lambda s, d: plain(query.downsample(bars_events(s, d), 400, keep_last=False).select("symbol", "date", "volume")),
        "downsample_spread": lambda s, d: plain(spread.downsample(bars_events(s, d), 500, "close", partitions=CHUNKS)),
        "topk_signals": lambda s, d: plain(query.markers(_signals(s, d)).select("symbol", "date", "close")),
    }
