"""Performance metrics per (symbol, run) as SQL aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.parse import rounded
from ledgerline.operators import backtest

KEYS = ("symbol", "run_id")


def drawdown(curve: DataFrame) -> DataFrame:
    """The curve with its running peak and drawdown (a fraction, 0 or below; null at peak 0)."""
    w = Window.partitionBy(*KEYS).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.try_divide(F.col("equity") - F.col("peak"), F.col("peak")))


def reason_counts(rows: DataFrame, reason: str) -> DataFrame:
    return rows.groupBy(*KEYS, F.col(reason).alias("reason")).agg(F.count("*").alias("n"))


def reason_map(rows: DataFrame, reason: str, name: str) -> DataFrame:
    """A map reason -> count; the number of reasons is fixed and small."""
    entries = F.array_sort(F.collect_list(F.struct("reason", "n")))
    return reason_counts(rows, reason).groupBy(*KEYS).agg(F.map_from_entries(entries).alias(name))


def map_rows(df: DataFrame, column: str) -> DataFrame:
    return df.select(*KEYS, F.explode(column).alias("reason", "n"))


def _d4(c: Column) -> Column:
    return rounded(c, 4)


def _peaked(tagged: DataFrame) -> DataFrame:
    """Adds the running peak of the equity, in the order of seq."""
    w = Window.partitionBy(*KEYS).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn("peak", F.max("equity.equity").over(w))


def metrics(tagged: DataFrame, peaked=_peaked) -> DataFrame:
    """One row per symbol and run: the metrics of metrics_and_span() alone."""
    return metrics_and_span(tagged, peaked).drop("span")


def metrics_and_span(tagged: DataFrame, peaked=_peaked) -> DataFrame:
    """One row per symbol and run, in one pass over the tagged rows: the running peak and all
    aggregates share one exchange. ``peaked`` adds the peak: spread.peaked() does so for runs with more
    bars than one task should read, and the rest is aggregated where the rows are. Runs without trades have zero counts and null averages. span
    holds the ends of the run's bars."""
    rows = peaked(tagged)
    is_ = lambda kind: F.col("kind") == kind
    net = F.col("trade.net_pnl")  # null but in trade rows
    won, lost = F.when(net > 0, net), F.when(net <= 0, net)
    down = F.when(is_("equity"), F.try_divide(F.col("equity.equity") - F.col("peak"), F.col("peak")))
    base = rows.groupBy(*KEYS).agg(
        F.first("initial_capital").alias("initial_capital"), F.max_by("equity.equity", F.when(is_("equity"), F.col("seq"))).alias("final_equity"),
        F.count_if(is_("trade")).alias("num_trades"), F.count(won).alias("num_wins"), F.count(lost).alias("num_losses"), F.count_if(is_("skip")).alias("num_signals_skipped"),
        F.avg(net).alias("avg_net_pnl"), F.avg(won).alias("avg_win_pnl"), F.avg(lost).alias("avg_loss_pnl"), F.try_divide(F.coalesce(F.sum(won), F.lit(0.0)), F.abs(F.sum(lost))).alias("profit_factor"),
        F.avg("trade.holding_days").alias("avg_holding_days"), F.max(net).alias("best_trade_net_pnl"), F.min(net).alias("worst_trade_net_pnl"),
        (100.0 * F.count_if(F.col("equity.position_quantity") > 0) / F.count_if(is_("equity"))).alias("exposure_pct"), (100.0 * F.coalesce(F.min(down), F.lit(0.0))).alias("max_drawdown_pct"),
        F.first("span", ignorenulls=True).alias("span"),
    )
    gain = F.col("final_equity") - F.col("initial_capital")
    return base.select(
        *KEYS, _d4(F.col("initial_capital")).alias("initial_capital"), _d4(F.col("final_equity")).alias("final_equity"), _d4(gain).alias("total_net_pnl"), _d4(F.try_divide(gain, F.col("initial_capital")) * 100.0).alias("total_return_pct"),
        (F.col("num_trades") + F.col("num_signals_skipped")).alias("num_signals_total"), F.col("num_trades").alias("num_signals_executed"), "num_signals_skipped", "num_trades", "num_wins", "num_losses",
        _d4(F.try_divide(F.col("num_wins").cast("double"), F.col("num_trades"))).alias("win_rate"),
        *(_d4(F.col(c)).alias(c) for c in ("avg_net_pnl", "avg_win_pnl", "avg_loss_pnl", "profit_factor", "max_drawdown_pct", "avg_holding_days", "exposure_pct", "best_trade_net_pnl", "worst_trade_net_pnl")),
        "span",
    )


def with_counts_and_config(summary: DataFrame, tagged: DataFrame, runs: DataFrame) -> DataFrame:
    """The metrics row with its reason maps and the configuration it ran with."""
    empty = F.create_map().cast("map<string,bigint>")
    out = summary.join(reason_map(backtest.trades(tagged), "exit_reason", "exit_reason_counts"), list(KEYS), "left")
    out = out.join(reason_map(backtest.skips(tagged), "reason", "skip_reason_counts"), list(KEYS), "left")
    config = F.struct(*runs.columns).alias("backtest_config")
    out = out.join(F.broadcast(runs.select("run_id", config)), "run_id")  # a configuration a row: a caller's list
    return out.withColumns({c: F.coalesce(c, empty) for c in ("exit_reason_counts", "skip_reason_counts")})
