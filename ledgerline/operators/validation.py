"""Walk-forward windows, buy-and-hold, parameter sensitivity and integrity gates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.parse import rounded
from ledgerline.operators.backtest import run_backtests
from ledgerline.operators.kernels import Config
from ledgerline.operators.metrics import metrics, metrics_and_span

OK, ZERO_TRADES, INSUFFICIENT = "OK", "ZERO_TRADES", "INSUFFICIENT_DATA"
#: One parameter at a time, the others at their defaults.
GRID = {"risk_per_trade": (0.005, 0.010, 0.015, 0.020), "atr_multiplier": (1.5, 2.0, 2.5, 3.0), "commission_rate": (0.0005, 0.0010, 0.0020)}


#: In the order in which they are checked.
GATES = ("NO_OVERLAP", "CHRONOLOGICAL", "SYMBOL_ISOLATION", "VALID_METRICS", "SENSITIVITY_BASELINE")


class IntegrityError(Exception):
    """A validation gate failed."""


def cutoffs(bars: DataFrame, dev_years: int = 3, step_months: int = 6, test_months: int = 6) -> DataFrame:
    """(symbol, window_index, low, high, last): the nominal test ranges, inclusive.

    Months are added one step after another: a day that a short month cuts off stays cut off.
    """
    ends = bars.groupBy("symbol").agg(F.min(F.to_date("date")).alias("first"), F.max(F.to_date("date")).alias("last"))
    start = F.add_months("first", 12 * dev_years)
    most = F.greatest(F.lit(0), F.ceil(F.months_between("last", start) / step_months)).cast("int") + 1
    steps = F.aggregate(F.sequence(F.lit(1), most), F.array(start), lambda a, _: F.concat(a, F.array(F.add_months(F.element_at(a, -1), step_months))))
    out = ends.withColumn("steps", F.filter(steps, lambda c: c < F.col("last"))).select("symbol", "last", F.posexplode("steps").alias("window_index", "low"))
    return out.select("symbol", "window_index", "low", F.least(F.add_months("low", test_months), "last").alias("high"), "last")


#: Edges of windows among days: a window begins before its first day and ends after its last.
BEGIN, DAY, END = 0, 1, 2


def lookup(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """windows (symbol, window_index, low, high) with the dates and counts of the bars before and in each.

    Days, a row per symbol and date with its count, and the windows' edges stand in one order, so what an
    edge has to know are running sums and the nearest days: no day meets a window. Bars are combined
    before the shuffle; what a symbol's group holds is its calendar, not its bars.
    """
    days = bars.select("symbol", F.to_date("date").alias("at")).where("at is not null").groupBy("symbol", "at").agg(F.count("*").alias("n"))
    edge = lambda column, kind: windows.select("symbol", F.col(column).alias("at"), F.lit(kind).alias("kind"), "window_index")
    marks = days.withColumn("kind", F.lit(DAY)).unionByName(edge("low", BEGIN), True).unionByName(edge("high", END), True)
    order = ("at", "kind", "window_index")
    on = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("symbol").orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    day = F.when(F.col("kind") == DAY, F.col("at"))
    seen = marks.withColumns({"upto": F.coalesce(F.sum("n").over(on), F.lit(0)), "first": F.min(day).over(on), "last": F.max(day).over(on), "next": F.min(day).over(back)})
    at = lambda kind, column: F.max(F.when(F.col("kind") == kind, F.col(column)))
    found = seen.where(F.col("kind") != DAY).groupBy("symbol", "window_index").agg(
        at(BEGIN, "at").alias("low"), at(END, "at").alias("high"), at(BEGIN, "first").alias("dev_start"), at(BEGIN, "last").alias("dev_end"), at(BEGIN, "upto").alias("dev_rows"),
        at(BEGIN, "next").alias("next"), at(END, "last").alias("last"), (at(END, "upto") - at(BEGIN, "upto")).alias("test_rows"),
    )
    some = F.col("test_rows") > 0
    return found.select(
        "symbol", "window_index", "low", "high", "dev_start", "dev_end", "dev_rows",
        F.when(some, F.col("next")).alias("test_start"), F.when(some, F.col("last")).alias("test_end"), "test_rows",
    )


def splits(bars: DataFrame, dev_years: int = 3, step_months: int = 6, test_months: int = 6, min_rows: int = 50) -> DataFrame:
    """The windows with actual first and last dates and row counts. Adjacent windows share a
    boundary day when it has a bar. Dates before a window are its expanding development part."""
    windows = cutoffs(bars, dev_years, step_months, test_months)
    out = lookup(bars, windows.select("symbol", "window_index", "low", "high"))
    return out.withColumn("status", F.when(F.col("test_rows") >= min_rows, OK).otherwise(INSUFFICIENT))


def slice_test(bars: DataFrame, low, high) -> DataFrame:
    return bars.where(F.to_date("date").between(low, high))


def slice_dev(bars: DataFrame, test_start) -> DataFrame:
    return bars.where(F.to_date("date") < test_start)


def buy_hold(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), config: Config = Config()) -> DataFrame:  # noqa: B008 - immutable
    """First open to last close with whole shares and costs on both legs; zeros with fewer than
    two bars or without a share."""
    ends = bars.groupBy(*keys).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.min_by("open", "date").alias("first_open"), F.max_by("close", "date").alias("last_close"), F.count("*").alias("n"))
    return held_between(ends, keys, config)


def held_between(ends: DataFrame, keys: tuple[str, ...], config: Config) -> DataFrame:
    """buy_hold() of ends (keys, start_date, end_date, first_open, last_close, n)."""
    capital = F.lit(config.initial_capital)
    bought, sold = F.col("first_open") * (1 + config.slippage_rate), F.col("last_close") * (1 - config.slippage_rate)
    out = ends.withColumn("bought", bought).withColumn("sold", sold)
    out = out.withColumn("quantity", F.when((F.col("n") >= 2) & (F.col("bought") > 0), F.floor(capital / F.col("bought"))).otherwise(F.lit(0)).cast("long"))
    held = F.col("quantity") > 0
    costs = F.col("bought") * F.col("quantity") * config.commission_rate + F.col("sold") * F.col("quantity") * config.commission_rate
    net = (F.col("sold") - F.col("bought")) * F.col("quantity") - costs
    number = lambda c: rounded(F.when(held, c).otherwise(F.lit(0.0)), 4)
    return out.select(
        *keys, F.when(held, F.col("start_date")).alias("start_date"), F.when(held, F.col("end_date")).alias("end_date"),
        number(F.col("first_open")).alias("entry_reference_price"), number(F.col("last_close")).alias("exit_reference_price"), number(F.col("bought")).alias("entry_price"), number(F.col("sold")).alias("exit_price"),
        "quantity", rounded(capital, 4).alias("initial_capital"), rounded(capital + F.when(held, net).otherwise(F.lit(0.0)), 4).alias("final_equity"), number(net).alias("total_net_pnl"),
        number(F.try_divide(net, capital) * 100.0).alias("total_return_pct"), number(costs).alias("transaction_cost"), F.when(held, F.col("n")).otherwise(F.lit(0)).cast("long").alias("num_trading_days"),
    )


#: The run over all bars, and the names of window runs.
FULL = "full"


def _window_name():
    return F.format_string("window %d", "window_index")


def window_runs(windows: DataFrame) -> DataFrame:
    """(symbol, run_id, first_date, last_date): a run per testable window, with fresh capital."""
    return windows.where(F.col("status") == OK).select("symbol", _window_name().alias("run_id"), F.col("low").alias("first_date"), F.col("high").alias("last_date"))


def walk_forward(table: DataFrame, windows: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Strategy, buy-and-hold and excess return of every window; zeros and the initial capital for
    windows with too few bars. ``table`` has features over the full history, sliced in the kernel."""
    return walk_of(metrics_and_span(run_backtests(table, {}, window_runs(windows), config)), windows, config)


def walk_of(done: DataFrame, windows: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """walk_forward() of what metrics_and_span() gives of the window runs."""
    run = F.struct("num_trades", "total_return_pct", "win_rate", "profit_factor", "max_drawdown_pct", "final_equity").alias("run")
    both = held_between(done.select("symbol", "run_id", run, "span.*"), ("symbol", "run_id", "run"), config)
    both = both.select("symbol", "run_id", "run.*", F.col("total_return_pct").alias("bh_total_return_pct"), F.col("final_equity").alias("bh_final_equity"))
    joined = windows.withColumn("run_id", _window_name()).join(both, ["symbol", "run_id"], "left")
    tested = F.col("status") == OK
    num = lambda c, other=0.0: F.when(tested, F.coalesce(F.col(c), F.lit(other))).otherwise(F.lit(other))
    strat, bench = num("total_return_pct"), num("bh_total_return_pct")
    return joined.select(
        "symbol", "window_index", "dev_start", "dev_end", "dev_rows", "test_start", "test_end", "test_rows",
        F.when(~tested, INSUFFICIENT).when(F.coalesce("num_trades", F.lit(0)) == 0, ZERO_TRADES).otherwise(OK).alias("status"),
        num("num_trades", 0).cast("long").alias("num_trades"), strat.alias("total_return_pct"), "win_rate", "profit_factor", num("max_drawdown_pct").alias("max_drawdown_pct"), num("final_equity", config.initial_capital).alias("final_equity"),
        bench.alias("bh_total_return_pct"), num("bh_final_equity", config.initial_capital).alias("bh_final_equity"), rounded(strat - bench, 4).alias("excess_return_pct"),
    )


def _mean(column: str, where):
    """The mean of a symbol's windows, added in their order: a sum of doubles depends on its order, and
    a mean on a tie would be rounded either way. There are a few windows a year."""
    values = F.array_sort(F.collect_list(F.when(where & F.col(column).isNotNull(), F.struct("window_index", F.col(column).alias("value")))))
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x["value"]), F.size(values))


def rollup(windows: DataFrame) -> DataFrame:
    """Counts of window kinds, and averages over OK windows only."""
    ok = F.col("status") == OK
    share = F.try_divide(100.0 * F.count_if(ok & (F.col("total_return_pct") > 0)), F.count_if(ok))
    return windows.groupBy("symbol").agg(
        F.count("*").alias("total_windows"), F.count_if(ok).alias("ok_windows"), F.count_if(F.col("status") == ZERO_TRADES).alias("zero_trade_windows"), F.count_if(F.col("status") == INSUFFICIENT).alias("insufficient_data_windows"),
        rounded(_mean("total_return_pct", ok), 4).alias("avg_return_pct"), rounded(_mean("bh_total_return_pct", ok), 4).alias("avg_bh_return_pct"), rounded(share, 2).alias("pct_profitable"),
    )


def variant(base: Config, name: str, value: float) -> Config:
    if name not in GRID:
        raise ValueError(f"unknown parameter {name}")
    return replace(base, **{name: value})


def grid(base: Config = Config()) -> dict[str, Config]:  # noqa: B008
    return {f"{name}={value:g}": variant(base, name, value) for name, values in GRID.items() for value in values}


def grid_table(spark: SparkSession, base: Config = Config()) -> DataFrame:  # noqa: B008
    """(run_id, param_name, param_value, is_baseline) of the grid."""
    rows = [(f"{n}={v:g}", n, float(v), v == getattr(base, n)) for n, values in GRID.items() for v in values]
    return spark.createDataFrame(rows, "run_id string, param_name string, param_value double, is_baseline boolean")


def grid_runs(bars: DataFrame, base: Config = Config()) -> DataFrame:  # noqa: B008
    """(symbol, run_id, param_name, param_value, is_baseline): the runs that the grid makes of each symbol."""
    points = [F.struct(F.lit(f"{n}={v:g}").alias("run_id"), F.lit(n).alias("param_name"), F.lit(float(v)).alias("param_value"), F.lit(v == getattr(base, n)).alias("is_baseline")) for n, values in GRID.items() for v in values]
    return bars.select("symbol").distinct().select("symbol", F.explode(F.array(*points)).alias("p")).select("symbol", "p.*")


def sensitivity(table: DataFrame, base: Config = Config()) -> DataFrame:  # noqa: B008
    """Metrics of each grid point over the full data."""
    return points_of(metrics(run_backtests(table, grid(base))), base)


def points_of(done: DataFrame, base: Config = Config()) -> DataFrame:  # noqa: B008
    """sensitivity() of what metrics() gives of the grid's runs."""
    keep = ("num_trades", "total_return_pct", "win_rate", "profit_factor", "max_drawdown_pct", "final_equity")
    points = F.broadcast(grid_table(done.sparkSession, base))  # as many rows as the grid has
    return done.join(points, "run_id").select("symbol", "param_name", "param_value", "is_baseline", *keep)


def all_runs(table: DataFrame, windows: DataFrame, base: Config = Config()) -> DataFrame:  # noqa: B008
    """Metrics and span of the full run, the grid's and the windows', from one pass over the bars."""
    return metrics_and_span(run_backtests(table, {FULL: base, **grid(base)}, window_runs(windows), base))


def full_of(done: DataFrame) -> DataFrame:
    return done.where(F.col("run_id") == FULL).drop("span")


def gate_violations(windows: DataFrame, points: DataFrame, full: DataFrame) -> DataFrame:
    """(symbol, gate, violations) for the five gates. ``full`` has the full run's num_trades; its symbols
    are those that windows may have. Windows with too few bars are held to their symbol only."""
    real = F.col("status") != INSUFFICIENT
    # Of the windows with enough bars, the start of the one before. A summary lists its windows by index;
    # where some share one, by start, so that equal starts stand together in any order.
    before = F.lag("test_start").over(Window.partitionBy("symbol", real).orderBy("window_index", "test_start"))
    known = full.select("symbol", F.lit(True).alias("known"), F.col("num_trades").alias("expected"))
    bad = (F.col("final_equity") < 0) | F.coalesce(~F.col("win_rate").between(0.0, 1.0), F.lit(False)) | (F.col("max_drawdown_pct") > 0)
    # A null symbol equals none, so it is no symbol of the full run.
    seen = windows.withColumn("before", before).join(known.drop("expected"), "symbol", "left").groupBy("symbol").agg(
        F.count_if(real & (F.col("dev_end") >= F.col("test_start"))).alias(GATES[0]),
        F.count_if(real & (F.col("test_start") <= F.col("before"))).alias(GATES[1]),
        F.count_if(F.col("known").isNull()).alias(GATES[2]),
        F.count_if(real & bad).alias(GATES[3]),
    )
    differs = (F.col("param_name") == "risk_per_trade") & (F.col("num_trades") != F.col("expected"))
    base = points.where("is_baseline").join(known.drop("known"), "symbol").groupBy("symbol").agg(F.count_if(differs).alias("differ"))
    based = known.select("symbol").join(base, "symbol", "left").select("symbol", F.coalesce("differ", F.lit(1)).alias(GATES[4]))
    both = seen.join(based, "symbol", "full_outer")
    gates = F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.coalesce(F.col(g), F.lit(0)).cast("long").alias("violations")) for g in GATES)))
    return both.select("symbol", gates.alias("g")).select("symbol", "g.gate", "g.violations")


def gate_status(violations: DataFrame) -> DataFrame:
    """(symbol, status): the first gate, in order, that a symbol fails, or PASSED. One aggregation."""
    failed = F.when(F.col("violations") > 0, F.struct(F.array_position(F.array(*map(F.lit, GATES)), F.col("gate")).alias("place"), "gate"))
    return violations.groupBy("symbol").agg(F.coalesce(F.min(failed)["gate"], F.lit("PASSED")).alias("status"))


def check_gates(violations: DataFrame) -> None:
    """Raise at the first gate, in order, that a symbol fails."""
    bad = violations.where("violations > 0").groupBy("gate").agg(F.sum("violations").alias("n"), F.min("symbol").alias("symbol")).collect()
    for r in sorted(bad, key=lambda r: GATES.index(r.gate)):
        raise IntegrityError(f"gate {r.gate}: {r.n} violations, first in {r.symbol}")
