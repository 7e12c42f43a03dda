"""Files in, artifacts out: the four plans over two symbols."""

import datetime as dt
import hashlib
import random

import pandas as pd
import pytest

from ledgerline.__main__ import main
from ledgerline.operators import query
from ledgerline.plans import pipelines
from ledgerline.sources import files


def write_raw(path, seed, n=1500):
    r, price, day, lines = random.Random(seed), 100.0, dt.date(2018, 1, 1), ["Date,Price,Open,High,Low,Vol.,Change %"]
    rows = []
    for _ in range(n):
        before, price = price, max(5.0, price * (1 + r.gauss(0.0005, 0.015)))
        o = before * (1 + r.gauss(0, 0.002))
        rows.append(f"{day:%m/%d/%Y},{price:.2f},{o:.2f},{max(o, price) * 1.01:.2f},{min(o, price) * 0.99:.2f},{r.uniform(1, 9):.2f}M,{(price / before - 1) * 100:.2f}%")
        day += dt.timedelta(days=1)
    lines += reversed(rows)  # vendors write the newest first
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8-sig")


def test_plans(spark, tmp_path, capsys):
    write_raw(tmp_path / "raw/stocks/TCS.csv", 1)
    write_raw(tmp_path / "raw/stocks/INFY.csv", 2)
    root = str(tmp_path)
    both = ["--root", root, "--symbols", "TCS", "infy"]
    assert main(["data", *both], spark) == 0
    bars = spark.read.parquet(f"{root}/processed/stocks")
    assert bars.count() == 3000 and bars.where("symbol = 'TCS' and date is null").isEmpty()
    assert main(["signals", *both], spark) == 0
    assert main(["backtest", *both, "--capital", "50000"], spark) == 0
    summary = spark.read.json(f"{root}/backtests/summary")
    assert summary.count() == 2 and query.lookup(summary, "tcs").first().backtest_config.initial_capital == 50000.0
    trades = spark.read.option("header", True).csv(f"{root}/backtests/trades")
    assert trades.count() == sum(r.num_trades for r in summary.collect()) > 0
    assert main(["validate", *both], spark) == 0
    assert "gates: PASSED" in capsys.readouterr().out
    done = spark.read.json(f"{root}/validation/summary")
    assert done.count() == 2 and all(r.total_windows >= 2 for r in done.collect())
    report = spark.read.json(f"{root}/reports/quality").where("symbol = 'TCS'").first()
    assert report.source_filename == "TCS.csv" and report.sha256 == hashlib.sha256((tmp_path / "raw/stocks/TCS.csv").read_bytes()).hexdigest()
    assert (report.original_rows, report.n_issues, report.cleaning_warnings) == (1500, 0, [])
    assert len(query.quality_view(spark.read.json(f"{root}/reports/quality")).columns) == 20
    pages = spark.read.text(f"{root}/validation/markdown").where("symbol = 'INFY'")
    assert pages.where("value like '## Windows%'").count() == 1
    text, names = query.context_text(pipelines.context(spark, root), "TCS")
    assert names == ["backtest summary", "data quality report", "walk-forward summary", "walk-forward windows", "sensitivity"]
    windows = next(r.total_windows for r in done.collect() if r.symbol == "TCS")
    assert text.count("test_range") == windows


def test_spread_signals_equal_those_of_one_task(spark, tmp_path):
    write_raw(tmp_path / "raw/stocks/TCS.csv", 1, 900)
    write_raw(tmp_path / "raw/stocks/INFY.csv", 2, 300)
    both = ["--root", str(tmp_path), "--symbols", "TCS", "INFY"]
    assert main(["data", *both], spark) == 0
    got = []
    for extra in ([], ["--spread"]):
        assert main(["signals", *both, *extra], spark) == 0
        table = spark.read.parquet(f"{tmp_path}/features/stocks").toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
        got.append(table[sorted(table.columns)])
    pd.testing.assert_frame_equal(*got, rtol=1e-9)


def test_plans_over_text_files(spark, tmp_path):
    """CSV between the plans gives what Parquet gives."""
    write_raw(tmp_path / "raw/stocks/TCS.csv", 1, 700)
    got = {}
    for fmt in ("parquet", "csv"):
        root = tmp_path / fmt
        root.mkdir()
        (root / "raw").symlink_to(tmp_path / "raw")
        for plan in ("data", "signals", "backtest"):
            assert main([plan, "--root", str(root), "--symbol", "TCS", "--format", fmt], spark) == 0
        got[fmt] = spark.read.json(f"{root}/backtests/summary").drop("generated_at").collect()
    assert got["csv"] == got["parquet"] and list(tmp_path.glob("csv/features/stocks/symbol=TCS/*.csv"))


def test_all_broken_rows_are_written(spark, tmp_path):
    path, root = tmp_path / "raw/stocks/TCS.csv", str(tmp_path)
    write_raw(path, 1, 300)
    assert main(["data", "--root", root, "--symbol", "TCS"], spark) == 0
    assert spark.read.parquet(f"{root}/reports/quality_ohlc").count() == spark.read.parquet(f"{root}/reports/quality_change").count() == 0
    lines = [x.split(",") for x in path.read_text(encoding="utf-8-sig").splitlines()]
    for x in lines[1:151]:  # the latest 150 days: high below low, and a false change
        x[3], x[6] = "0.01", "77%"
    path.write_text("\n".join(",".join(x) for x in lines) + "\n", encoding="utf-8-sig")
    assert main(["data", "--root", root, "--symbol", "TCS"], spark) != 0
    broken = {dt.datetime.strptime(x[0], "%m/%d/%Y").date() for x in lines[1:151]}
    done = spark.read.json(f"{root}/reports/quality").first()
    assert (done.n_ohlc, done.n_change, done.status) == (150, 150, "FAIL")
    for name in ("quality_ohlc", "quality_change"):
        rows = spark.read.parquet(f"{root}/reports/{name}").collect()
        assert len(rows) == 150 and {r.date for r in rows} == broken and {r.symbol for r in rows} == {"TCS"}


def test_bad_calls(spark, tmp_path):
    with pytest.raises(KeyError):
        main(["data", "--root", str(tmp_path), "--symbol", "NOPE"], spark)
    with pytest.raises(FileNotFoundError):
        main(["data", "--root", str(tmp_path)], spark)
    with pytest.raises(SystemExit):
        main(["data", "--root", "x", "--symbol", "A", "--symbols", "B"], spark)


def test_broken_artifacts_count_as_absent(spark, tmp_path):
    root, names = str(tmp_path), ["AAA", "BBB", "CCC", "DDD", "EEE"]
    (tmp_path / "backtests/summary").mkdir(parents=True)
    for s in names:
        text = f'{{"symbol": "{s}", "num_trades": 3}}' if s != "CCC" else '{"symbol": "CCC", "num_tr'
        (tmp_path / f"backtests/summary/part-{s}.json").write_text(text + "\n\n")
    (tmp_path / "reports/quality").mkdir(parents=True)
    (tmp_path / "reports/quality/part.json").write_text('{"symbol": "CCC", "status": "PASS"}\n["no object"]\n{"status": "of none"}\n')
    (tmp_path / "validation/points").mkdir(parents=True)
    (tmp_path / "validation/points/part-0.parquet").write_bytes(b"no table")
    context = pipelines.context(spark, root)
    told = {s: query.context_text(context, s)[1] for s in names}
    assert told == {s: ["backtest summary"] if s != "CCC" else ["data quality report"] for s in names}
    assert '"num_trades' not in query.context_text(context, "CCC")[0]
    spark.createDataFrame([("AAA", 1)], "symbol string, n long").write.mode("append").parquet(f"{root}/validation/points")
    assert query.context_text(pipelines.context(spark, root), "AAA")[1] == ["backtest summary", "sensitivity"]
    read = lambda **more: files.read_artifact(spark, f"{root}/backtests/summary", **more)
    assert sorted(r.symbol for r in read(whole=True).collect()) == ["AAA", "BBB", "DDD", "EEE"]
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        read(strict=True).collect()
    assert files.read_artifact(spark, f"{root}/none") is None and files.read_table(spark, f"{root}/none") is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_artifact(spark, f"{root}/none", strict=True)
