"""Data-quality checks of canonical bars: predicates and aggregates per symbol."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.schemas import BAR_COLUMNS, BARS

PASS, WARNING, FAIL = "PASS", "WARNING", "FAIL"
TOLERANCE = 0.005
#: Rule name -> (left, right): violated when left < right or left > right, in this order.
OHLC_RULES = {"high<low": ("high", "<", "low"), "high<open": ("high", "<", "open"), "high<close": ("high", "<", "close"), "low>open": ("low", ">", "open"), "low>close": ("low", ">", "close")}


def column_drift(columns: list[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) canonical columns, sorted; the source's change and place may stay."""
    have = set(columns)
    return sorted(set(BAR_COLUMNS) - have), sorted(have - set(BAR_COLUMNS) - {"change_pct_src", "_src_row"})


def missing_counts(bars: DataFrame) -> DataFrame:
    """(symbol, missing_counts): nulls by column, -1 for a column that isn't there."""
    named = [c for c in BAR_COLUMNS if c != "symbol"]
    pairs = [x for c in named for x in (F.lit(c), F.count_if(F.col(c).isNull()) if c in bars.columns else F.lit(-1).cast("long"))]
    return bars.groupBy("symbol").agg(F.create_map(*pairs).alias("missing_counts"))


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """Rows that break a rule, with the rules' names in order; rows with a null price pass."""
    return _broken(bars).where(F.size("violated_rules") > 0)


def volume_counts(bars: DataFrame) -> DataFrame:
    v = F.col("volume")
    return bars.groupBy("symbol").agg(F.count_if(v.isNull()).alias("missing"), F.count_if(v == 0).alias("zero"), F.count_if(v < 0).alias("negative"))


def backward_dates(bars: DataFrame, order: str = "_src_row") -> DataFrame:
    """(symbol, n): rows whose date isn't after the one before, in arrival order."""
    w = Window.partitionBy("symbol").orderBy(order)
    step = F.col("date") <= F.lag("date").over(w)
    return bars.select("symbol", step.alias("back")).groupBy("symbol").agg(F.count_if("back").alias("n"))


def _broken(bars: DataFrame) -> DataFrame:
    """Adds violated_rules: the rules that a row with all prices breaks, in order."""
    broken = F.array(*(F.when(F.col(a) < F.col(b) if op == "<" else F.col(a) > F.col(b), F.lit(name)) for name, (a, op, b) in OHLC_RULES.items()))
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    return bars.withColumn("violated_rules", F.when(whole, F.filter(broken, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")))


def _stepped(bars: DataFrame) -> DataFrame:
    """Adds what compares a row with the one before: backward, computed and difference. Rows are in
    the order of dates, then of the source; those without a date come last."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").asc_nulls_last(), *(c for c in ("_src_row",) if c in bars.columns))
    out = bars.withColumn("backward", F.col("date") <= F.lag("date").over(w)).withColumn("computed", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    change = F.col("change_pct_src") if "change_pct_src" in bars.columns else F.lit(None).cast("double")
    return out.withColumn("difference", F.abs(F.col("computed") - change))


def change_mismatches(bars: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows whose source change differs from close / previous close - 1 by more than tolerance."""
    return _stepped(bars).drop("backward").where(F.col("difference") > tolerance)


def violation_rows(bars: DataFrame) -> DataFrame:
    """Every OHLC violation, as the report's artifact has it."""
    return ohlc_violations(bars).select("symbol", "date", "open", "high", "low", "close", "violated_rules")


def mismatch_rows(bars: DataFrame) -> DataFrame:
    """Every change mismatch, as the report's artifact has it."""
    return change_mismatches(bars).select("symbol", "date", "computed", "change_pct_src", "difference")


def notes(spark: SparkSession, by_symbol: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(symbol, cleaning_warnings, cleaning_errors), as sources and cleaning gave them."""
    rows = [(s, w, e) for s, (w, e) in by_symbol.items()]
    return spark.createDataFrame(rows, "symbol string, cleaning_warnings array<string>, cleaning_errors array<string>")


def report(bars: DataFrame, about: DataFrame | None = None, tolerance: float = TOLERANCE, stepped=None) -> DataFrame:
    """One row per symbol, counts and status, in one pass over the bars: one window and one aggregation
    share the exchange by symbol.

    ``stepped`` (spread.stepped) compares rows with those before in place of the window, for symbols with more
    bars than one task should read; all else combines before its shuffle. ``about`` is what notes() gives. FAIL: errors, missing columns, OHLC violations, dates that do not
    ascend, volumes of zero or less; WARNING: warnings, further columns, missing volumes, change
    mismatches. The rows behind n_ohlc and n_change are those of violation_rows() and
    mismatch_rows(), tables of their own, since they have no bound.
    """
    missing, further = column_drift(bars.columns)
    for c in missing:
        bars = bars.withColumn(c, F.lit(None).cast(BARS[c].dataType))
    rows, v = (_broken(bars) if stepped else _stepped(_broken(bars))), F.col("volume")
    named = [c for c in BAR_COLUMNS if c != "symbol"]
    pairs = [x for c in named for x in (F.lit(c), F.lit(-1).cast("long") if c in missing else F.count_if(F.col(c).isNull()))]
    counts = {
        "missing_counts": F.create_map(*pairs), "rows": F.count("*"), "invalid_dates": F.count_if(F.col("date").isNull()), "date_min": F.min("date"), "date_max": F.max("date"),
        "missing": F.count_if(v.isNull()), "zero": F.count_if(v == 0), "negative": F.count_if(v < 0),
        "n_ohlc": F.count_if(F.size("violated_rules") > 0),
    }
    steps = {"n_backward": F.count_if("backward"), "n_change": F.count_if(F.col("difference") > tolerance)}
    named_ = lambda columns: [c.alias(n) for n, c in columns.items()]
    if stepped:
        out = rows.groupBy("symbol").agg(*named_(counts)).join(stepped(bars).groupBy("symbol").agg(*named_(steps)), "symbol", "left")
        out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in steps})
    else:
        out = rows.groupBy("symbol").agg(*named_(counts | steps))
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    out = out.withColumn("missing_columns", strings(missing)).withColumn("unexpected_columns", strings(further))
    if about is None:
        out = out.withColumn("cleaning_warnings", strings([])).withColumn("cleaning_errors", strings([]))
    else:
        out = out.join(about, "symbol", "left").withColumns({c: F.coalesce(c, strings([])) for c in ("cleaning_warnings", "cleaning_errors")})
    lists = ("cleaning_errors", "missing_columns", "cleaning_warnings", "unexpected_columns")
    any_of = lambda *names: reduce(or_, ((F.size(c) if c in lists else F.col(c)) > 0 for c in names))
    failed = any_of("cleaning_errors", "missing_columns", "n_ohlc", "n_backward", "zero", "negative")
    warned = any_of("cleaning_warnings", "unexpected_columns", "missing", "n_change")
    return out.withColumn("status", F.when(failed, FAIL).when(warned, WARNING).otherwise(PASS))
