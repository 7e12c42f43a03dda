"""Sinks: partitioned tables, ledgers, JSON artifacts and Markdown reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.parse import rounded
from ledgerline.schemas import BAR_COLUMNS, EQUITY_FIELDS, SIGNAL_COLUMNS, TRADE_FIELDS

#: Broken rows that a Markdown report shows.
FIRST = 20


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The seven columns, a folder per symbol, so that reads of one symbol prune the others."""
    _write(bars.select(*BAR_COLUMNS), path, fmt)


def write_features(table: DataFrame, path: str, fmt: str = "parquet", spread: bool = False) -> None:
    _write(table.select(*SIGNAL_COLUMNS), path, fmt, spread)


def _write(df: DataFrame, path: str, fmt: str, spread: bool = False) -> None:
    """A file a symbol; with spread several in the order of dates, so that no symbol is one task's."""
    dealt = df.repartitionByRange("symbol", "date") if spread else df.repartition("symbol")
    w = dealt.sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy("symbol")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def trade_rows(ledger: DataFrame) -> DataFrame:
    """The ledger as files have it: four digits, six for the range, the return in percent."""
    digits = {"atr_at_signal": 6}
    out = []
    for name, kind in TRADE_FIELDS:
        c = F.col(name) * 100 if name == "return_pct" else F.col(name)
        out.append((rounded(c, digits.get(name, 4)) if kind == "double" else c).alias(name))
    return ledger.select(out[0], "symbol", *out[1:])


def equity_columns() -> list:
    return [(rounded(F.col(n), 4) if k == "double" else F.col(n)).alias(n) for n, k in EQUITY_FIELDS]


def equity_rows(curve: DataFrame) -> DataFrame:
    return curve.select(*equity_columns())


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, also without rows."""
    if df.isEmpty():
        df = df.repartition(1)  # Spark writes headers per partition: keep one
    df.write.mode("overwrite").option("header", True).csv(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def walk_forward_json(windows: DataFrame) -> DataFrame:
    """(symbol, json): counts and nested windows, a document per symbol."""
    strategy = F.struct("num_trades", "total_return_pct", "win_rate", "profit_factor", "max_drawdown_pct", "final_equity").alias("strategy")
    held = F.struct(F.col("bh_total_return_pct").alias("total_return_pct"), F.col("bh_final_equity").alias("final_equity")).alias("buy_and_hold")
    w = F.struct("window_index", "dev_start", "dev_end", "dev_rows", "test_start", "test_end", "test_rows", "status", strategy, held, "excess_return_pct")
    n = lambda s: F.count_if(F.col("status") == s)
    doc = windows.groupBy("symbol").agg(F.count("*").alias("total_windows"), n("OK").alias("ok_windows"), n("ZERO_TRADES").alias("zero_trade_windows"), n("INSUFFICIENT_DATA").alias("insufficient_data_windows"), F.array_sort(F.collect_list(w)).alias("windows"))
    return doc.select("symbol", F.to_json(F.struct(*doc.columns), {"ignoreNullFields": "false"}).alias("json"))


def splits_json(windows: DataFrame) -> DataFrame:
    w = F.struct("window_index", "dev_start", "dev_end", "dev_rows", "test_start", "test_end", "test_rows", "status")
    doc = windows.groupBy("symbol").agg(F.count("*").alias("total_windows"), F.array_sort(F.collect_list(w)).alias("windows"))
    return doc.select("symbol", F.to_json(F.struct(*doc.columns), {"ignoreNullFields": "false"}).alias("json"))


def sensitivity_json(points: DataFrame) -> DataFrame:
    p = F.struct("param_name", "param_value", "is_baseline", "num_trades", "total_return_pct", "win_rate", "profit_factor", "max_drawdown_pct", "final_equity")
    return points.groupBy("symbol").agg(F.to_json(F.array_sort(F.collect_list(p)), {"ignoreNullFields": "false"}).alias("json"))


def section(df: DataFrame, title: str, columns: tuple[str, ...], order: tuple[str, ...], first: int | None = None) -> DataFrame:
    """(symbol, text): a Markdown table of a symbol's rows; of its first few where a report shows a
    sample. A symbol's rows are as many as its windows, grid points or runs."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    if first is not None:
        df = df.withColumn("_nth", F.row_number().over(Window.partitionBy("symbol").orderBy(*order))).where(F.col("_nth") <= first)
    lines = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"_{k}") for k, c in enumerate(order)), line.alias("line"))))
    head = f"## {title}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return df.groupBy("symbol").agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("text"))


def document(title: str, *sections: DataFrame) -> DataFrame:
    """(symbol, value): the sections of a symbol's report, in order."""
    rows = reduce(DataFrame.unionByName, (s.withColumn("place", F.lit(k)) for k, s in enumerate(sections)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return rows.groupBy("symbol").agg(F.concat(F.format_string(f"# {title}: %s\n\n", "symbol"), F.array_join(texts, "\n\n"), F.lit("\n")).alias("value"))


def write_document(doc: DataFrame, path: str) -> None:
    doc.write.mode("overwrite").partitionBy("symbol").text(path)


def quality_markdown(summary: DataFrame, violations: DataFrame, mismatches: DataFrame) -> DataFrame:
    """Counts of cleaning and checks; of the broken rows the first FIRST, as they have no bound."""
    counts = section(summary, "Status", ("rows", "date_min", "date_max", "status"), ("symbol",))
    cleaning = section(summary, "Cleaning", ("original_rows", "final_rows", "removed_rows", "exact_duplicates", "duplicate_dates", "n_issues"), ("symbol",))
    checks = section(summary, "Checks", ("invalid_dates", "missing", "zero", "negative", "n_ohlc", "n_backward", "n_change"), ("symbol",))
    rules = violations.withColumn("rules", F.array_join("violated_rules", ", "))
    broken = section(rules, "OHLC violations", ("date", "open", "high", "low", "close", "rules"), ("date", "rules"), FIRST)
    changes = section(mismatches, "Change mismatches", ("date", "computed", "change_pct_src", "difference"), ("date", "difference"), FIRST)
    return document("Data quality", counts, cleaning, checks, broken, changes)


def backtest_markdown(summary: DataFrame) -> DataFrame:
    columns = ("run_id", "initial_capital", "final_equity", "total_return_pct", "num_trades", "win_rate", "profit_factor", "max_drawdown_pct", "exposure_pct")
    return document("Backtest", section(summary, "Runs", columns, ("run_id",)))


def validation_markdown(rolled: DataFrame, windows: DataFrame, points: DataFrame) -> DataFrame:
    """Every window and every grid point."""
    return document(
        "Validation",
        section(rolled, "Summary", tuple(c for c in rolled.columns if c != "symbol"), ("symbol",)),
        section(windows, "Windows", ("window_index", "test_start", "test_end", "status", "total_return_pct", "bh_total_return_pct", "excess_return_pct"), ("window_index",)),
        section(points, "Sensitivity", ("param_name", "param_value", "num_trades", "total_return_pct"), ("param_name", "param_value")),
    )
