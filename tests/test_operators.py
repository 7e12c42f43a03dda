"""Parsing, cleaning, quality, features, validation and the read surface on literal rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ledgerline import sinks
from ledgerline.functions import parse
from ledgerline.operators import backtest, clean, features, metrics, quality, query, validation
from ledgerline.operators.kernels import Config
from ledgerline.schemas import RAW_COLUMNS, SIGNAL_COLUMNS
from ledgerline.sources import catalog, files


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (parse.parse_volume, {"21.48M": 21480000.0, "1.5K": 1500.0, "1.2B": 1.2e9, "3.5m": 3500000.0, "12345": 12345.0, "  10.00M  ": 1e7, "": None, "-": None, "N/A": None, "1,234": None, "x": None, None: None}),
        (parse.parse_change_pct, {"-0.35%": -0.0035, "2.39%": 0.0239, "0.00%": 0.0, "": None, "-": None, "2.39": None, "−1%": None, None: None}),
        (parse.parse_date, {"05/29/2025": dt.date(2025, 5, 29), " 1/5/2020 ": dt.date(2020, 1, 5), "2025-05-29": None, "13/01/2020": None, "01/05/20": None, "": None, "x": None, None: None}),
        (parse.parse_price, {"418.75": 418.75, "100": 100.0, "1,234.56": 1234.56, "": None, "-": None, "bad": None, "10d": None, "1_000": None, None: None}),
    ],
)
def test_parsers(spark, fn, cases):
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.v for r in df.select("s", fn(F.col("s")).alias("v")).collect()}
    assert set(got) == set(cases)
    for k, want in cases.items():
        assert got[k] == (pytest.approx(want) if isinstance(want, float) else want), k


def raw(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_src_row long, " + ", ".join(f"`{c}` string" for c in RAW_COLUMNS))


def test_clean_keeps_the_first_and_reports(spark):
    one = ("05/01/2024", "100.00", "99.00", "101.00", "98.00", "1.5M", "1.00%")
    rows = [one, one, ("05/01/2024", "200", "1", "2", "1", "1M", "0%"), ("bad", "1", "1", "1", "1", "-", ""), (None, "2", "2", "2", "2", "1M", "1%"), ("05/02/2024", "x", "1", "2", "1", "1M", "1%")]
    c = clean.clean(raw(spark, rows), "ABC")
    counts = c.counts.first()
    assert (counts.original_rows, counts.exact_duplicates, counts.duplicate_dates, counts.duplicate_date_rows, counts.final_rows, counts.removed_rows) == (6, 1, 1, 1, 4, 2)
    kept = {r._src_row: r for r in c.bars.collect()}
    assert sorted(kept) == [0, 3, 4, 5] and kept[0].close == 100.0 and kept[0].symbol == "ABC"
    assert {(r.row_index, r.field, r.reason) for r in c.issues.collect()} == {(None, "row", "1 exact duplicates"), (None, "Date", "date of 2 rows"), (1, "row", "exact duplicate"), (2, "row", "duplicate date"), (3, "Date", "unparseable"), (3, "Vol.", "unparseable"), (5, "Price", "unparseable")}
    with pytest.raises(ValueError):
        clean.clean(raw(spark, rows).drop("Date"), "ABC")
    lacking = clean.clean(raw(spark, rows).drop("Price", "Vol."), "ABC")
    assert lacking.errors == ["no column Price"] and lacking.warnings == ["no column Vol.: volume is null"]
    about = quality.notes(spark, {"ABC": (lacking.warnings, lacking.errors)})
    assert quality.report(lacking.bars, about).first().status == "FAIL"
    assert clean.clean(raw(spark, rows).drop("Vol."), "ABC").bars.where("volume is not null").count() == 0


BAR = "date date, symbol string, open double, high double, low double, close double, volume double, change_pct_src double, _src_row long"


def test_quality(spark):
    d = dt.date
    good = (d(2024, 1, 1), "A", 10.0, 12.0, 9.0, 11.0, 5.0, None, 0)
    bad = (d(2024, 1, 2), "B", 10.0, 8.0, 9.0, 11.0, 0.0, 0.5, 1)
    none = (d(2024, 1, 3), "C", None, 8.0, 9.0, 11.0, None, None, 2)
    df = spark.createDataFrame([good, bad, none, (d(2024, 1, 4), "A", 11.0, 13.0, 10.0, 12.1, 5.0, 0.1, 3), (d(2024, 1, 5), "A", 11.0, 13.0, 10.0, 12.1, 5.0, 0.5, 4)], BAR)
    assert [(r.symbol, r.violated_rules) for r in quality.ohlc_violations(df).collect()] == [("B", ["high<low", "high<open", "high<close"])]
    assert [r.date for r in quality.change_mismatches(df).where("symbol = 'A'").collect()] == [d(2024, 1, 5)]
    status = {r.symbol: r.status for r in quality.report(df).collect()}
    assert status == {"A": "WARNING", "B": "FAIL", "C": "WARNING"}
    assert quality.report(df.where("symbol = 'A' and date < '2024-01-05'")).first().status == "PASS"
    assert quality.column_drift(["date", "symbol", "open", "high", "low", "extra"]) == (["close", "volume"], ["extra"])
    back = spark.createDataFrame([("A", d(2024, 1, 2), 0), ("A", d(2024, 1, 1), 1), ("A", d(2024, 1, 1), 2)], "symbol string, date date, _src_row long")
    assert quality.backward_dates(back).first().n == 2


def frame(spark, n=60, symbol="A", start=dt.date(2020, 1, 1), price=lambda i: 100.0, volume=5e6):
    rows = [(start + dt.timedelta(days=i), symbol, price(i), price(i) + 1, price(i) - 1, price(i), volume) for i in range(n)]
    return spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double")


def test_features_of_constant_prices_and_warm_up(spark):
    t = features.features(frame(spark).unionByName(frame(spark, symbol="B", price=lambda i: 50.0 + i)))
    a = t.where("symbol = 'A'").orderBy("date").collect()
    assert all(r.ema20 == 100.0 for r in a) and a[-1].sma50 == 100.0 and a[-1].momentum_20 == 0.0
    first = lambda c: next(i for i, r in enumerate(a) if r[c] is not None)
    assert {c: first(c) for c in ("ema20", "sma20", "sma50", "avg_volume_20", "volume_ratio", "atr14", "momentum_5", "previous_high_20")} == {"ema20": 0, "sma20": 19, "sma50": 49, "avg_volume_20": 19, "volume_ratio": 19, "atr14": 13, "momentum_5": 5, "previous_high_20": 20}
    alone = features.features(frame(spark)).orderBy("date").collect()
    assert alone == a  # another symbol changes nothing
    assert features.features(frame(spark, volume=0.0)).where("volume_ratio is not null").count() == 0


def test_truncation_changes_no_feature(spark):
    walk = lambda i: 100.0 + (i * 7919 % 13) - i * 0.1
    long = {r.date: r for r in features.signal_table(frame(spark, 90, price=walk)).collect()}
    short = features.signal_table(frame(spark, 70, price=walk)).collect()
    assert len(short) == 70 and all(long[r.date] == r for r in short)
    assert tuple(features.signal_table(frame(spark, 5)).columns) == SIGNAL_COLUMNS


def test_conditions(spark):
    row = {"symbol": "A", "date": "2024-01-01", "close": 105.0, "ema20": 102.0, "ema50": 100.0, "volume_ratio": 2.0, "previous_high_20": 104.0}
    cases = [({}, "LONG"), ({"ema50": 102.0}, "NO_SIGNAL"), ({"close": 102.0}, "NO_SIGNAL"), ({"previous_high_20": 105.0}, "NO_SIGNAL"), ({"volume_ratio": 1.5}, "NO_SIGNAL"), ({"volume_ratio": None}, "NO_SIGNAL"), ({"previous_high_20": None}, "NO_SIGNAL")]
    schema = "symbol string, date string, close double, ema20 double, ema50 double, volume_ratio double, previous_high_20 double"
    for change, want in cases:
        df = spark.createDataFrame([tuple((row | change).values())], schema)
        assert features.signals(df).first().signal == want, change
    with pytest.raises(ValueError):
        features.signals(df.drop("ema20"))


def test_metrics_and_reports(spark):
    t = features.signal_table(frame(spark, 120, price=lambda i: 100 + i * 0.5 + (3 if i % 10 == 0 else 0))).withColumn("signal", F.when(F.dayofmonth("date") == 5, "LONG").otherwise("NO_SIGNAL"))
    configs = {"full": Config()}
    tagged = backtest.run_backtests(t, configs).cache()
    m = metrics.metrics(tagged).first()
    ledger = backtest.trades(tagged).collect()
    assert m.num_trades == len(ledger) > 0 and m.final_equity == pytest.approx(100_000 + sum(x.net_pnl for x in ledger), abs=1e-3)
    whole = metrics.with_counts_and_config(metrics.metrics(tagged), tagged, backtest.config_table(spark, configs)).first()
    assert sum(whole.exit_reason_counts.values()) == m.num_trades and whole.backtest_config.risk_per_trade == 0.01
    rows = sinks.trade_rows(backtest.trades(tagged)).collect()
    assert rows[0].return_pct == pytest.approx(ledger[0].return_pct * 100, abs=1e-4)
    assert "| full |" in sinks.backtest_markdown(metrics.metrics(tagged)).where("symbol = 'A'").first().value
    none = backtest.run_backtests(t.withColumn("signal", F.lit("NO_SIGNAL")), configs)
    z = metrics.metrics(none).first()
    assert (z.num_trades, z.win_rate, z.profit_factor, z.final_equity, z.max_drawdown_pct) == (0, None, None, 100000.0, 0.0)
    down = spark.createDataFrame([("A", "r", f"{i}", e) for i, e in enumerate((100e3, 110e3, 88e3, 95e3))], "symbol string, run_id string, date string, equity double")
    assert metrics.drawdown(down).agg(F.min("drawdown")).first()[0] == pytest.approx(-0.2)


def test_splits_and_walk_forward(spark):
    ramp = frame(spark, 500, price=lambda i: 100 + 0.05 * i, volume=1e6)
    w = validation.splits(ramp, 1, 4, 3).orderBy("window_index").collect()
    assert [r.status for r in w] == ["OK", "INSUFFICIENT_DATA"] and w[0].dev_end < w[0].test_start and w[0].dev_rows == 366
    shared = validation.splits(frame(spark, 900), 1, 6, 6).orderBy("window_index").collect()
    assert shared[0].test_end == shared[1].test_start  # a boundary day belongs to both
    drift = validation.cutoffs(frame(spark, 900, start=dt.date(2020, 8, 31)), 0, 6, 6).orderBy("window_index").collect()
    assert [r.low.day for r in drift][:4] == [31, 28, 28, 28]
    table = features.signal_table(frame(spark, 900, price=lambda i: 100 + 0.05 * i)).withColumn("signal", F.when(F.dayofmonth("date") == 21, "LONG").otherwise("NO_SIGNAL"))
    table = table.cache()
    windows = validation.splits(table, 1, 6, 6).cache()
    done = validation.walk_forward(table, windows).cache()
    rows = done.collect()
    assert all(r.excess_return_pct == pytest.approx(r.total_return_pct - r.bh_total_return_pct, abs=1e-4) for r in rows)
    points = validation.sensitivity(table).cache()
    assert points.count() == 11 and {r.param_name for r in points.where("is_baseline").collect()} == set(validation.GRID)
    full = metrics.metrics(backtest.run_backtests(table, {"full": Config()})).cache()
    gates = validation.gate_violations(done, points, full)
    assert gates.count() == 5
    validation.check_gates(gates)
    for change, gate in (({"dev_end": F.col("test_start")}, "NO_OVERLAP"), ({"test_start": F.lit(dt.date(2000, 1, 1)), "dev_end": F.lit(dt.date(1999, 1, 1))}, "CHRONOLOGICAL"), ({"final_equity": F.lit(-1.0)}, "VALID_METRICS")):
        with pytest.raises(validation.IntegrityError, match=gate):
            validation.check_gates(validation.gate_violations(done.withColumns(change), points, full))
    for symbol in (None, "OTHER"):
        foreign = done.withColumn("symbol", F.when(F.col("window_index") == 0, F.lit(symbol).cast("string")).otherwise(F.col("symbol")))
        with pytest.raises(validation.IntegrityError, match="SYMBOL_ISOLATION: 1 "):
            validation.check_gates(validation.gate_violations(foreign, points, full))
    # A window with too few bars is held to its symbol only.
    short = done.withColumns({"status": F.lit("INSUFFICIENT_DATA"), "dev_end": F.col("test_start"), "final_equity": F.lit(-1.0)})
    validation.check_gates(validation.gate_violations(short, points, full))
    # One pass over the bars gives the same rows.
    whole = validation.all_runs(table, windows).cache()
    assert sorted(validation.walk_of(whole, windows).collect()) == sorted(rows) and sorted(validation.points_of(whole).collect()) == sorted(points.collect())
    assert sorted(validation.full_of(whole).collect()) == sorted(full.collect())
    with pytest.raises(validation.IntegrityError, match="SENSITIVITY"):
        validation.check_gates(validation.gate_violations(done, points.where("not is_baseline"), full))
    assert validation.rollup(done).first().total_windows == len(rows)
    with pytest.raises(ValueError):
        validation.variant(Config(), "nothing", 1.0)
    assert '"buy_and_hold"' in sinks.walk_forward_json(done).first().json and '"window_index"' in sinks.splits_json(windows).first().json and '"is_baseline"' in sinks.sensitivity_json(points).first().json
    text = sinks.validation_markdown(validation.rollup(done), done, points).first().value
    assert text.index("## Summary") < text.index("## Windows") < text.index("## Sensitivity")
    assert text.count("| ") >= len(rows) + 11 and all(str(r.test_end) in text for r in rows)
    # A report has every window, however many; only broken rows are a sample.
    lots = spark.range(1500).select(F.lit("A").alias("symbol"), F.col("id").alias("window_index"))
    assert len(sinks.section(lots, "Windows", ("window_index",), ("window_index",)).first().text.splitlines()) == 1504
    assert len(sinks.section(lots, "Windows", ("window_index",), ("window_index",), 20).first().text.splitlines()) == 24


def test_rollup_does_not_depend_on_the_order_of_rows(spark):
    """Both means are ties in decimals: added in another order, the doubles round to -0.0879 and 35.7884."""
    returns, held = (0.0738, -0.231, 0.3666, 0.1851, -0.1733, -0.7489), (53.6304, 175.7358, -96.4768, -18.3315, 112.2715, -12.0987)
    rows = [("A", k, "OK", x, y) for k, (x, y) in enumerate(zip(returns, held))]
    rows += [("A", 6, "ZERO_TRADES", 0.0, 9.0), ("A", 7, "INSUFFICIENT_DATA", 0.0, 0.0), ("B", 0, "ZERO_TRADES", 0.0, 1.0)]
    for order in ((0, 1, 2, 3, 4, 5), (1, 4, 2, 5, 3, 0)):
        data = spark.createDataFrame([*(rows[k] for k in order), *rows[6:]], "symbol string, window_index long, status string, total_return_pct double, bh_total_return_pct double").coalesce(1)
        got = {r.symbol: tuple(r)[1:] for r in validation.rollup(data).collect()}
        assert got == {"A": (8, 6, 1, 1, -0.088, 35.7885, 50.0), "B": (1, 0, 1, 0, None, None, None)}


def test_buy_hold(spark):
    free = Config(initial_capital=10_000, slippage_rate=0, commission_rate=0)
    df = frame(spark, 16, price=lambda i: 100.0 + i)
    r = validation.buy_hold(df, config=free).first()
    assert (r.quantity, r.total_net_pnl, r.total_return_pct) == (100, 1500.0, 15.0)
    one = validation.buy_hold(df.limit(1), config=free).first()
    assert (one.quantity, one.final_equity, one.num_trading_days, one.start_date) == (0, 10_000.0, 0, None)


def test_read_surface(spark):
    t = features.signal_table(frame(spark, 50).unionByName(frame(spark, 5, "B")))
    assert query.ohlcv(t, "A", "2020-01-03", "2020-01-05").count() == 3
    assert len(query.feature_range(t, "A").columns) == 20
    assert query.downsample(t, 20).where("symbol = 'A'").count() == 18 and query.downsample(t, 20, False).where("symbol = 'A'").count() == 17
    ledger = spark.createDataFrame([("A", i, f"2024-01-{i:02d}", f"2024-01-{i + 1:02d}", f"2024-02-{i:02d}", "STOP_LOSS" if i % 2 else "TREND_EXIT", float(i % 5)) for i in range(1, 28)], "symbol string, trade_id long, signal_date string, entry_date string, exit_date string, exit_reason string, net_pnl double")
    assert query.search_trades(ledger, "2024-01-03").count() == 2 and query.search_trades(ledger, "", "STOP_LOSS").count() == 14 and query.search_trades(ledger, "27").count() == 2
    assert [r.trade_id for r in query.page(query.sort_trades(ledger, "net_pnl", False), 2).collect()] == [20, 25]
    assert query.exit_reasons(ledger).count() == 2
    with pytest.raises(KeyError):
        catalog.guard(t, "nope")
    with pytest.raises(catalog.DataNotAvailable):
        catalog.guard(t, "tcs")
    assert [r.symbol for r in catalog.available(t, spark.createDataFrame([("A",), ("Z",)], "symbol string")).collect()] == ["A"]
    windows = spark.createDataFrame([("A", i, "2020-01-01", "2020-06-30", "OK", 1.0 * i, 2.0) for i in range(35)], "symbol string, window_index long, test_start string, test_end string, status string, total_return_pct double, bh_total_return_pct double")
    context = query.research_context({"summary": t.where("symbol = 'A'").limit(1), "gone": None, "windows": query.narrow_windows(windows)})
    text, names = query.context_text(context, "A")
    assert names == ["summary", "windows"] and text.startswith("## summary") and text.count("test_range") == 35
    with pytest.raises(ValueError):
        query.research_context({"gone": None})


def test_files(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("﻿Date, Price,Open,High,Low,Vol.,Change %\n05/29/2025, 418.75,1,2,3,1M,1%\n", encoding="utf-8")
    df, report = files.load_raw(spark, str(path))
    assert report.ok and report.rows == 1 and df.first()["Price"] == "418.75" and df.columns[0] == "Date"
    assert files.unchanged(spark, str(path), report.sha256)
    path.write_text("Date,Open,Extra\n1,2,3\n")
    assert not files.unchanged(spark, str(path), report.sha256)
    _, drift = files.load_raw(spark, str(path))
    assert not drift.ok and "unexpected column Extra" in drift.warnings
    with pytest.raises(ValueError):
        files.VendorCsv().load(spark, str(path), "abc")
    with pytest.raises(FileNotFoundError):
        files.load_raw(spark, str(tmp_path / "none.csv"))
    path.write_text("Date,Open\n")
    with pytest.raises(ValueError):
        files.load_raw(spark, str(path))
    t = features.signal_table(frame(spark, 5))
    sinks.write_features(t, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("symbol = 'A'").count() == 5
    assert sorted(files.features_table(spark, str(tmp_path / "f")).collect()) == sorted(t.collect())
    sinks.write_features(t, str(tmp_path / "fc"), "csv")
    typed = files.features_table(spark, str(tmp_path / "fc"), "csv")
    assert typed.schema == files.FEATURES and sorted(typed.collect()) == sorted(t.collect())
    assert sorted(files.signals_only(spark, str(tmp_path / "fc"), "csv").collect()) == sorted(t.select("symbol", "date", "signal").collect())
    b = frame(spark, 4)
    sinks.write_bars(b, str(tmp_path / "bc"), "csv")
    assert sorted(files.bars_table(spark, str(tmp_path / "bc"), "csv").collect()) == sorted(b.collect())
    sinks.write_csv(t.where("false"), str(tmp_path / "e"))
    assert "signal" in "".join(p.read_text() for p in (tmp_path / "e").glob("*.csv"))
    assert files.read_json(spark, str(tmp_path / "no.json")) is None
    (tmp_path / "bad.json").write_text("{")
    assert files.read_json(spark, str(tmp_path / "bad.json")) is None
    with pytest.raises(Exception):
        files.read_json(spark, str(tmp_path / "no.json"), strict=True)


def test_streaming_bars_equal_batch(spark, sf, tmp_path):
    from ledgerline.streaming.bars import streaming_averages, streaming_bars

    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "*"))
    q = streaming_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    bars = streaming_bars(events)
    assert sorted(spark.table("bars_out").collect()) == sorted(bars.collect()) and not bars.isEmpty()
    bars.repartition(1).write.parquet(str(tmp_path / "bars" / "a"))
    s = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "bars" / "*"))
    q = streaming_averages(s).writeStream.outputMode("append").format("memory").queryName("avg_out").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.symbol, r.date): r.ema20 for r in features.features(bars).collect()}
    got = spark.table("avg_out").collect()
    assert len(got) == len(want) and all(abs(r.ema20 - want[(r.symbol, r.date)]) < 1e-9 for r in got)


def _files_one_by_one(spark, frames, path):
    """A stream that gets each frame in a batch of its own."""
    for k, df in enumerate(frames):
        df.coalesce(1).write.parquet(str(path / f"{k}"))
        for f in (path / f"{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 60 * k,) * 2)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path / "*"))


def test_late_events_are_left_out_and_bars_close(spark, tmp_path):
    from ledgerline.streaming.bars import streaming_bars

    def events(*rows):
        at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
        return spark.createDataFrame([(i, at(m), "click", float(v)) for i, m, v in rows], "event_id long, ts timestamp, event_type string, value double")

    first = events((1, 1, 10), (2, 14, 12), (3, 20, 7), (4, 61, 5))
    then = events((8, 62, 6))  # a batch later the watermark of 51 holds for late rows, too
    late = events((5, 3, 99), (6, 55, 8), (7, 130, 1))  # minute 3 is behind it, 55 is not
    q = streaming_bars(_files_one_by_one(spark, [first, then, late], tmp_path / "in")).writeStream.outputMode("append").format("memory").queryName("closed").start()
    q.processAllAvailable()
    q.stop()
    got = {r.date: tuple(r[2:]) for r in spark.table("closed").collect()}
    want = {r.date: tuple(r[2:]) for r in streaming_bars(first.unionByName(then).unionByName(late.where("event_id <> 5"))).collect()}
    last = max(want)
    assert got == {d: v for d, v in want.items() if d != last} and got[min(got)] == (10.0, 12.0, 10.0, 12.0, 22.0)


def test_averages_keep_their_state_across_batches(spark, tmp_path):
    from ledgerline.streaming.bars import streaming_averages

    own = frame(spark, 60, price=lambda i: 100.0 + i % 7).unionByName(frame(spark, 60, "B", price=lambda i: 50.0 + i)).withColumn("date", F.col("date").cast("timestamp"))
    cut = F.lit(dt.datetime(2020, 1, 1)) + F.expr("interval 20 days")
    parts = [own.where(F.col("date") < cut), own.where(F.col("date") >= cut)]
    q = streaming_averages(_files_one_by_one(spark, parts, tmp_path / "bars")).writeStream.outputMode("append").format("memory").queryName("kept").start()
    q.processAllAvailable()
    assert len(q.recentProgress) >= 2
    q.stop()
    want = {(r.symbol, r.date): (r.ema20, r.ema50, r.atr14) for r in features.features(own).collect()}
    got = {(r.symbol, r.date): (r.ema20, r.ema50, r.atr14) for r in spark.table("kept").collect()}
    assert set(got) == set(want)
    for k, row in want.items():
        assert got[k][:2] == pytest.approx(row[:2]) and (row[2] is None) == (got[k][2] is None or got[k][2] != got[k][2]) and (row[2] is None or got[k][2] == pytest.approx(row[2]))


def test_rounding_is_by_the_binary_value_with_ties_to_even(spark):
    import random

    r = random.Random(1)
    xs = [r.uniform(-1000, 1000) for _ in range(3000)] + [round(r.uniform(-100, 100), 4) + 5e-5 for _ in range(9000)] + [k / 32 for k in range(-200, 200)] + [6.30315, 2.675, 0.0, 1e12 + 0.00005]
    df = spark.createDataFrame(list(enumerate(xs)), "i long, x double")
    got = [row.y for row in df.select("i", parse.rounded(F.col("x"), 4).alias("y")).orderBy("i").collect()]
    assert got == [round(x, 4) for x in xs]


def test_windows_that_share_an_index_are_ordered_by_start(spark):
    rows = [(3, "2001-01-01"), (3, "2000-01-01"), (4, "2002-01-01"), (4, "2002-01-01")]
    windows = spark.createDataFrame(rows, "window_index int, test_start string").selectExpr(
        "'A' as symbol", "window_index", "cast(test_start as date) as test_start", "date'1999-01-01' as dev_end", "'OK' as status", "1.0 as final_equity", "0.5 as win_rate", "0.0 as max_drawdown_pct"
    )
    points = spark.createDataFrame([("A", "risk_per_trade", True, 1)], "symbol string, param_name string, is_baseline boolean, num_trades long")
    full = spark.createDataFrame([("A", 1)], "symbol string, num_trades long")
    for n in (1, 3):
        got = {g.gate: g.violations for g in validation.gate_violations(windows.repartition(n), points, full).collect()}
        assert got == {"NO_OVERLAP": 0, "CHRONOLOGICAL": 1, "SYMBOL_ISOLATION": 0, "VALID_METRICS": 0, "SENSITIVITY_BASELINE": 0}


def test_first_failed_gate_of_each_symbol(spark):
    failed = {"A": (), "B": ("SYMBOL_ISOLATION", "VALID_METRICS"), "C": ("NO_OVERLAP", "SENSITIVITY_BASELINE"), None: ("SYMBOL_ISOLATION",)}
    rows = [(s, g, int(g in bad)) for s, bad in failed.items() for g in validation.GATES[::-1]]
    violations = spark.createDataFrame(rows, "symbol string, gate string, violations long")
    got = {r.symbol: r.status for r in validation.gate_status(violations).collect()}
    assert got == {"A": "PASSED", "B": "SYMBOL_ISOLATION", "C": "NO_OVERLAP", None: "SYMBOL_ISOLATION"}
    assert validation.gate_status(violations.where("false")).count() == 0
    # The runner raises at the first of these, in the gates' order.
    with pytest.raises(validation.IntegrityError, match="NO_OVERLAP: 1 violations, first in C"):
        validation.check_gates(violations)


def _days(spark, rows):
    return spark.createDataFrame(rows, "symbol string, date string").withColumn("date", F.col("date").cast("date"))


def test_windows_look_days_up_without_meeting_them(spark):
    import random

    r = random.Random(4)
    rows = [(s, str(dt.date(2000, 1, 1) + dt.timedelta(r.randrange(2400)))) for s in "ABC" for _ in range(400)] + [("D", "2001-05-05"), ("E", None)]
    bars = _days(spark, rows)
    plan = validation.splits(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    got = {(x.symbol, x.window_index): x for x in validation.splits(bars, min_rows=20).collect()}
    assert len(got) > 9 and not any(k[0] in "DE" for k in got)
    for (s, _), x in got.items():
        own = sorted(dt.date.fromisoformat(d) for t, d in rows if t == s)
        dev, test = [d for d in own if d < x.low], [d for d in own if x.low <= d <= x.high]
        ends = lambda v: (v[0], v[-1], len(v)) if v else (None, None, 0)
        assert (x.dev_start, x.dev_end, x.dev_rows) == ends(dev) and (x.test_start, x.test_end, x.test_rows) == ends(test)
        assert x.status == ("OK" if len(test) >= 20 else "INSUFFICIENT_DATA")


def test_an_empty_window_has_no_dates(spark):
    bars = _days(spark, [("A", "2000-01-01"), ("A", "2003-03-01"), ("A", "2004-12-01")])
    got = {x.window_index: x for x in validation.splits(bars).collect()}
    assert got[1].test_rows == 0 and got[1].test_start is None and got[1].test_end is None and got[1].dev_rows == 2


def test_lookup_combines_a_hot_symbols_bars_before_the_shuffle(spark):
    bars = spark.range(0, 1_000_000, 1, 8).select(F.lit("HOT").alias("symbol"), F.timestamp_seconds(F.col("id") * 600).alias("date"))
    x = validation.splits(bars).agg(F.count("*").alias("n"), F.max("dev_rows").alias("dev"), F.sum("test_rows").alias("test")).first()
    assert x.n > 20 and x.dev < 1_000_000


@pytest.mark.parametrize("ascending", [True, False])
def test_pages_after_a_row_are_the_sorted_ledger(spark, ascending):
    import random

    r = random.Random(3)
    ledger = spark.createDataFrame([(s, k, r.choice([None, 1.0, 2.5, -3.0, 7.0])) for s in "AB" for k in range(23)], "symbol string, trade_id long, net_pnl double")
    want = [tuple(x) for x in query.sort_trades(ledger, "net_pnl", ascending).collect()]
    got, last = [], None
    while rows := query.page_after(ledger, "net_pnl", ascending, last, 7).collect():
        got += [tuple(x) for x in rows]
        last = query.sort_key(rows[-1], "net_pnl")
    assert got == want
    plan = query.page_after(ledger, "net_pnl", ascending, last, 7)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_duplicates_of_one_row_and_one_date_are_combined_in_the_tasks(spark):
    n = 1_000_000
    raw = spark.range(0, n, 1, 12).select(
        F.lit("HOT").alias("symbol"), F.col("id").alias("_src_row"), F.lit("01/02/2024").alias("Date"), *(F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(7).cast("string").alias(c) for c in ("Price", "Open", "High", "Low", "Vol.")), F.lit("1%").alias("Change %")
    )
    assert raw.rdd.getNumPartitions() >= 8
    done = clean.clean(raw)
    for df in (done.bars, done.counts, done.issues):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Cartesian" not in plan
    c = done.counts.first()
    assert (c.original_rows, c.final_rows, c.exact_duplicates, c.duplicate_dates, c.duplicate_date_rows, c.removed_rows) == (n, 1, n - 101, 1, 100, n - 1)
    assert [(x._src_row, x.close) for x in done.bars.collect()] == [(0, 0.0)]
    assert done.issues.where("reason = 'exact duplicate'").count() == n - 101 and done.issues.where("reason = 'duplicate date'").count() == 100


def test_duplicates_with_missing_strings_and_dates(spark):
    rows = [("A", 0, None, "1"), ("A", 1, None, "1"), ("A", 2, None, "2"), ("A", 3, "01/02/2024", " 5 "), ("A", 4, "01/02/2024", "5"), ("A", 5, "01/02/2024", "6"), ("B", 0, "bad", "1")]
    done = clean.clean(spark.createDataFrame(rows, "symbol string, _src_row long, Date string, Price string"))
    assert sorted((r.symbol, r._src_row) for r in done.bars.collect()) == [("A", 0), ("A", 2), ("A", 3), ("B", 0)]
    listed = [r.symbol for r in done.issues.collect()]
    assert {r.symbol: r.n_issues for r in done.counts.collect()} == {s: listed.count(s) for s in "AB"}
    told = sorted((r.symbol, r.row_index, r.reason) for r in done.issues.collect() if r.row_index is not None)
    assert told == [("A", 1, "exact duplicate"), ("A", 4, "exact duplicate"), ("A", 5, "duplicate date"), ("B", 0, "unparseable")]
