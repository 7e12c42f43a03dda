"""Queries over files: vendor CSV, tables and artifacts that they write from the given tables and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import sinks
from ledgerline.functions.parse import rounded
from ledgerline.operators import clean, features, metrics, quality, validation
from ledgerline.operators.scan import shared_folder, written
from ledgerline.plans import pipelines
from ledgerline.schemas import RAW_COLUMNS
from ledgerline.sources import catalog, files, vendor
from ledgerline.sources.bars import bars_events, bars_orders, raw_events


def vendor_files(spark: SparkSession, rows: DataFrame, order: str, columns: tuple[str, ...] = RAW_COLUMNS) -> dict[str, str]:
    """rows (symbol, order, columns) as vendors give them: a CSV file per symbol, in order. symbol -> path."""
    where = shared_folder(spark)
    rows.repartition("symbol").sortWithinPartitions("symbol", order).select("symbol", *(f"`{c}`" for c in columns)).write.partitionBy("symbol").option("header", True).option("emptyValue", "").csv(where)
    names = [r.symbol for r in rows.select("symbol").distinct().collect()]  # the file list
    context = spark.sparkContext
    out = {}
    for s in names:
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{where}/symbol={s}")
        system = folder.getFileSystem(context._jsc.hadoopConfiguration())
        out[s] = next(p for p in (str(x.getPath().toString()) for x in system.listStatus(folder)) if p.endswith(".csv"))
    return out


def _raw_files(spark: SparkSession, d: str) -> dict[str, str]:
    return vendor_files(spark, raw_events(spark, d).where("_src_row < 1000000000"), "_src_row")


def scan_files(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all vendor files from one scan, and what stands first and last in each."""
    rows = vendor.scan_all(spark, _raw_files(spark, d)).rows
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.count("Date").alias("n_dates"), F.count("`Vol.`").alias("n_volumes"), F.min_by("Price", "_src_row").alias("first_price"), F.max_by("Price", "_src_row").alias("last_price"))


def scan_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row that the scan reads, as the strings that the file holds."""
    rows = vendor.scan_all(spark, _raw_files(spark, d)).rows
    return rows.select("symbol", *(F.col(f"`{c}`").alias(n) for c, n in zip(RAW_COLUMNS, STRINGS)))


STRINGS = ("raw_date", "raw_price", "raw_open", "raw_high", "raw_low", "raw_volume", "raw_change")


def scan_reports(spark: SparkSession, d: str) -> DataFrame:
    """What the files are: columns that lack or are too many, rows, and whether their bytes stayed."""
    rows = raw_events(spark, d).where("_src_row < 1000000000").withColumn("Note", F.lit("x"))
    columns = tuple(c for c in (*RAW_COLUMNS, "Note") if c not in ("Vol.", "High"))
    got = vendor.scan_all(spark, vendor_files(spark, rows, "_src_row", columns))
    text = [F.array_join(c, "; ").alias(c) for c in ("warnings", "errors")]
    still = F.lit(not vendor.changed(spark, got.reports)) & (F.length("sha256") == 64) & (F.col("bytes") > 0)
    return got.reports.select("symbol", "n_rows", *text, still.alias("unchanged"))


def vendor_source(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two symbols from the data source, parsed."""
    files_ = {s: p.removeprefix("file:") for s, p in _raw_files(spark, d).items()}
    rows = vendor.vendor(spark, files_, ["click", "purchase"])
    return clean.clean(rows).counts.drop("n_issues")


def _written_bars(spark: SparkSession, d: str, fmt: str) -> str:
    where = shared_folder(spark)
    sinks.write_bars(bars_orders(spark, d), where, fmt)
    return where


def bars_table(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    """Canonical bars, written and read again."""
    return lambda spark, d: files.bars_table(spark, _written_bars(spark, d, fmt), fmt)


def _written_features(spark: SparkSession, d: str, fmt: str) -> str:
    where = shared_folder(spark)
    sinks.write_features(features.signal_table(bars_orders(spark, d)), where, fmt)
    return where


def features_table(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: files.features_table(spark, _written_features(spark, d, fmt), fmt)


def signals_only(spark: SparkSession, d: str) -> DataFrame:
    """What an overview reads of a feature table in text files."""
    return features.signal_summary(files.signals_only(spark, _written_features(spark, d, "csv"), "csv"))


def _artifact(spark: SparkSession, d: str, broken: bool) -> str:
    """Row counts by symbol as a JSON artifact, of which that of one symbol is cut off, if asked."""
    where = shared_folder(spark)
    n = bars_events(spark, d).groupBy("symbol").agg(F.count("*").alias("n_bars"), F.max("high").alias("high"))
    text = F.to_json(F.struct("symbol", "n_bars", "high"))
    n.select(F.when((F.col("symbol") == "click") & F.lit(broken), F.substring(text, 1, 20)).otherwise(text).alias("value")).write.text(where)
    return where


def artifact(strict: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        read = files.read_artifact(spark, _artifact(spark, d, not strict), strict=strict)
        return read.select("symbol", F.get_json_object("json", "$.n_bars").cast("long").alias("n_bars"), F.get_json_object("json", "$.high").cast("double").alias("high"))

    return run


def quality_json(spark: SparkSession, d: str) -> DataFrame:
    """The quality report as written, read from its JSON."""
    where = shared_folder(spark)
    done = clean.clean(raw_events(spark, d))
    sinks.write_json(quality.report(done.bars).join(done.counts, "symbol"), where)
    kinds = "symbol string, status string, rows long, original_rows long, removed_rows long, n_ohlc long, n_change long, date_min string, date_max string, missing_counts map<string,long>"
    return spark.read.schema(kinds).json(where).withColumn("missing_close", F.col("missing_counts")["close"]).drop("missing_counts")


def gate_status(violations: DataFrame) -> DataFrame:
    """The first gate that each of the caller's symbols fails."""
    return validation.gate_status(violations).where("symbol is not null")


def _vendor_bars(spark: SparkSession, d: str) -> tuple[str, list[str], dict[str, catalog.Symbol]]:
    """Daily bars as vendor files in the layout of the plans: (root, symbols, catalog)."""
    number = lambda c: rounded(F.col(c), 4).cast("decimal(18,4)").cast("string")
    rows = bars_orders(spark, d).select(
        F.regexp_replace(F.upper("symbol"), "[^A-Z0-9]", "").alias("symbol"), F.col("date").alias("day"), F.date_format("date", "MM/dd/yyyy").alias("Date"),
        *(number(c).alias(n) for c, n in (("close", "Price"), ("open", "Open"), ("high", "High"), ("low", "Low"), ("volume", "Vol."))), F.lit(None).cast("string").alias("Change %"),
    )
    made = vendor_files(spark, rows, "day")
    root = shared_folder(spark)
    context = spark.sparkContext
    for s, path in made.items():
        source, target = (context._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{root}/raw/stocks/{s}.csv"))
        system = source.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(target.getParent())
        system.rename(source, target)
    return root, sorted(made), {s: catalog.Symbol(s, f"{s}.csv", s) for s in made}


def _planned(spark: SparkSession, d: str, *plans: str) -> str:
    root, symbols, known = _vendor_bars(spark, d)
    pipelines.data(spark, root, symbols, known)
    for name in plans:
        getattr(pipelines, name)(spark, root, symbols)
    return root


def plan_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars that the data plan writes from vendor files."""
    return files.bars_table(spark, f"{_planned(spark, d)}/processed/stocks")


def plan_signals(spark: SparkSession, d: str) -> DataFrame:
    return features.signal_summary(files.signals_only(spark, f"{_planned(spark, d, 'signals')}/features/stocks"))


def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summaries that the backtest plan writes, read from their JSON."""
    root = _planned(spark, d, "signals", "backtests")
    kinds = "symbol string, num_trades long, final_equity double, total_return_pct double, win_rate double, exit_reason_counts map<string,long>"
    done = spark.read.schema(kinds).json(f"{root}/backtests/summary")
    return done.withColumn("n_exits", F.aggregate(F.map_values("exit_reason_counts"), F.lit(0).cast("long"), lambda a, x: a + x)).drop("exit_reason_counts")


def plan_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows that the validation plan writes."""
    done = spark.read.parquet(f"{_planned(spark, d, 'signals', 'validate')}/validation/windows")
    return done.select("symbol", "window_index", "test_start", "test_end", "test_rows", "status", "num_trades", "final_equity", "bh_final_equity")


def plan_trades(spark: SparkSession, d: str) -> DataFrame:
    """The trades that the backtest plan writes, read from their CSV."""
    root = _planned(spark, d, "signals", "backtests")
    return spark.read.option("header", True).csv(f"{root}/backtests/trades").selectExpr("symbol", "cast(trade_id as long) as trade_id", "exit_reason", "cast(entry_price as double) as entry_price", "cast(net_pnl as double) as net_pnl", "cast(return_pct as double) as return_pct")


def catalog_of(spark: SparkSession, d: str) -> DataFrame:
    """A catalog made from the symbols of a table of bars."""
    return catalog.derived(bars_events(spark, d))


def queries(plain: Callable[..., DataFrame], broken_gates: Callable[[SparkSession, str], DataFrame]) -> dict:
    own = {
        "scan_files": scan_files, "scan_rows": scan_rows, "scan_reports": scan_reports, "vendor_source": vendor_source,
        "bars_csv": bars_table("csv"), "bars_parquet": bars_table("parquet"), "features_csv": features_table("csv"), "features_parquet": features_table("parquet"), "signals_csv": signals_only,
        "artifact_tolerant": artifact(False), "artifact_strict": artifact(True), "quality_json": quality_json,
        "gate_status": lambda s, d: gate_status(broken_gates(s, d)),
        "plan_bars": plan_bars, "plan_signals": plan_signals, "plan_summary": plan_summary, "plan_trades": plan_trades, "plan_windows": plan_windows,
    }
    # Means of prices with five digits often end in a 5 at the seventh.
    return {name: (lambda s, d, q=q, n=8 if name.startswith("features") else 6: plain(q(s, d), n)) for name, q in own.items()}
