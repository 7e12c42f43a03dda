"""The read surface: ranges, ledgers, overviews, and what a client does with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.features import LONG
from ledgerline.schemas import SIGNAL_COLUMNS

PAGE = 25


def between(df: DataFrame, symbol: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One symbol's rows, dates inclusive. Apply it to finished features, never before them."""
    out = df.where(F.col("symbol") == symbol)
    kind = dict(df.dtypes)["date"]
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast(kind))
    return out if end is None else out.where(F.col("date") <= F.lit(end).cast(kind))


def ohlcv(bars: DataFrame, symbol: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return between(bars, symbol, start, end).select("date", "open", "high", "low", "close", "volume")


def feature_range(table: DataFrame, symbol: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return between(table, symbol, start, end).select(*(c for c in SIGNAL_COLUMNS if c != "symbol"))


def overview(table: DataFrame, summary: DataFrame) -> DataFrame:
    dates = table.groupBy("symbol").agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.count("*").alias("rows"), F.count_if(F.col("signal") == LONG).alias("n_long"))
    return dates.withColumn("n_columns", F.lit(len(SIGNAL_COLUMNS))).join(summary, "symbol")


def search_trades(ledger: DataFrame, needle: str = "", exit_reason: str | None = None) -> DataFrame:
    """Trades of an exit reason whose dates or number contain the needle."""
    text = needle.strip().lower()
    out = ledger if exit_reason is None else ledger.where(F.col("exit_reason") == exit_reason)
    fields = [F.col(c).cast("string") for c in ("signal_date", "entry_date", "exit_date", "trade_id")]
    hit: Column = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(f), F.lit(text))
    return out.where(hit) if text else out


def sort_trades(ledger: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    return ledger.orderBy(F.col(column).asc() if ascending else F.col(column).desc(), "symbol", "trade_id")


def page(ordered: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """Page 1 is the first; pages below it are page 1."""
    return ordered.offset((max(1, number) - 1) * size).limit(size)


def page_after(ledger: DataFrame, column: str, ascending: bool = True, last: tuple | None = None, size: int = PAGE) -> DataFrame:
    """The page of sort_trades() that follows a row, told by its (value, symbol, trade_id); the first without
    one. A filter and a top-k: no page sorts the ledger or counts the rows before it, and rows that come
    in between shift nothing. Missing values stand where the sort has them, first in ascending order."""
    keys = ((column, ascending), ("symbol", True), ("trade_id", True))
    if last is not None:
        beyond, same = F.lit(False), F.lit(True)
        for (name, up), value in zip(keys, last):
            c = F.col(name)
            further = (c.isNotNull() if up else F.lit(False)) if value is None else F.coalesce(c > value, F.lit(False)) if up else (c < value) | c.isNull()
            beyond, same = beyond | (same & further), same & c.eqNullSafe(F.lit(value))
        ledger = ledger.where(beyond)
    return sort_trades(ledger, column, ascending).limit(size)


def sort_key(row, column: str) -> tuple:
    """What page_after() needs of the last row of a page."""
    return row[column], row["symbol"], row["trade_id"]


def exit_reasons(ledger: DataFrame) -> DataFrame:
    return ledger.select("exit_reason").distinct()


def downsample(df: DataFrame, most: int, keep_last: bool = True, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every ceil(n / most)-th row per key in date order, and the last one if asked."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("_i", F.row_number().over(w.orderBy("date")) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    keep = F.col("_i") % step == 0
    return out.where(keep | (F.col("_i") == F.col("_n") - 1) if keep_last else keep).drop("_i", "_n")


def markers(sampled: DataFrame, most: int = 100) -> DataFrame:
    """The first LONG rows, a top-k by date."""
    return sampled.where(F.col("signal") == LONG).orderBy("date", "symbol").limit(most)


#: The fields of a quality report that its reader sees, and their columns.
QUALITY_VIEW = {
    "original_row_count": "original_rows", "final_row_count": "final_rows", "removed_row_count": "removed_rows", "date_min": "date_min", "date_max": "date_max", "missing_counts": "missing_counts",
    "duplicate_exact_count": "exact_duplicates", "duplicate_date_count": "duplicate_dates", "invalid_ohlc_count": "n_ohlc", "invalid_volume_count": "missing", "zero_volume_count": "zero", "negative_volume_count": "negative",
    "invalid_date_count": "invalid_dates", "non_monotonic_date_count": "n_backward", "change_pct_mismatch_count": "n_change", "cleaning_issue_count": "n_issues", "status": "status",
}


def quality_view(report: DataFrame) -> DataFrame:
    """The reader's fields of a whole quality report, dates as text."""
    text = lambda n, c: F.coalesce(F.col(c).cast("string"), F.lit("")) if n.startswith("date") else F.col(c)
    about = [c for c in ("source_filename", "generated_at") if c in report.columns]
    return report.select("symbol", *about, *(text(n, c).alias(n) for n, c in QUALITY_VIEW.items()))


def narrow_windows(walked: DataFrame) -> DataFrame:
    """A row per symbol: counts, and every window with the few columns that a reader compares."""
    window = F.struct(
        F.col("window_index").alias("window"), F.concat_ws(" to ", F.col("test_start").cast("string"), F.col("test_end").cast("string")).alias("test_range"), "status",
        F.col("total_return_pct").alias("strategy_return_pct"), F.col("bh_total_return_pct").alias("bh_return_pct"),
    )
    return walked.groupBy("symbol").agg(F.count("*").alias("total_windows"), F.count_if(F.col("status") == "OK").alias("ok_windows"), F.array_sort(F.collect_list(window)).alias("windows_summary"))


def research_context(artifacts: dict[str, DataFrame | None]) -> DataFrame:
    """(symbol, place, source, text): every artifact's rows of a symbol as JSON, in the order given;
    artifacts that are missing give none. An artifact is a table, or (symbol, json) with JSON of its own.
    A symbol's summaries, windows and grid points are few."""
    out = None
    for place, (name, df) in enumerate(artifacts.items()):
        if df is None:
            continue
        row = F.col("json") if df.columns == ["symbol", "json"] else F.to_json(F.struct(*(f"`{c}`" for c in df.columns if c != "symbol")))
        many = df.groupBy("symbol").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("text"))
        part = many.select("symbol", F.lit(place).alias("place"), F.lit(name).alias("source"), "text")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no artifact is there")
    return out


def context_text(context: DataFrame, symbol: str) -> tuple[str, list[str]]:
    """One symbol's context as text, and the names of its sources."""
    rows = sorted(context.where(F.col("symbol") == symbol).collect(), key=lambda r: r.place)
    return "\n\n".join(f"## {r.source}\n{r.text}" for r in rows), [r.source for r in rows]


def lookup(df: DataFrame, symbol: str) -> DataFrame:
    """A symbol's rows of a summary, ledger, curve or report; the symbol in any case."""
    return df.where(F.col("symbol") == symbol.upper())
