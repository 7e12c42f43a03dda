"""Scans over chunks: equal to the one-task operators, wherever the chunks end."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import features, metrics, quality, query, spread
from ledgerline.operators.kernels import ema, wilder
from ledgerline.operators.scan import CHUNK, chunks


def walk(n, seed=0, missing=0.0):
    r = np.random.default_rng(seed)
    close = 200 + np.cumsum(r.normal(0, 1, n))
    f = pd.DataFrame({"date": pd.date_range("2000-01-03", periods=n, freq="min"), "symbol": "A", "open": close, "high": close + r.uniform(0, 2, n), "low": close - r.uniform(0, 2, n), "close": close, "volume": r.uniform(0, 9, n)})
    f.loc[r.random(n) < missing, "close"] = np.nan
    return f


def cut_up(frame, along, ends):
    """along over the pieces of a frame that end at ``ends``."""
    state, out = None, []
    for a, b in zip([0, *ends], [*ends, len(frame)]):
        if b > a:
            part = frame.iloc[a:b].reset_index(drop=True)
            out.append(along.apply(state, part))
            state = along.advance(state, along.summarize(part))
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_chunks_may_end_anywhere(seed, missing):
    r = np.random.default_rng(seed)
    f = walk(int(r.integers(1, 200)), seed, missing)
    ends = sorted(r.integers(0, len(f) + 1, int(r.integers(1, 12))).tolist())
    got, whole = cut_up(f, spread.Features(), ends), spread.Features().apply(None, f)
    for c in spread.ADDED:
        np.testing.assert_allclose(got[c], whole[c], rtol=1e-11, atol=1e-11, equal_nan=True, err_msg=c)
    close = f["close"]
    np.testing.assert_allclose(whole["ema20"], ema(close, 20), equal_nan=True)
    np.testing.assert_allclose(whole["atr14"], wilder(whole["true_range"].to_numpy()), equal_nan=True)
    np.testing.assert_allclose(whole["sma20"], close.rolling(20).mean(), equal_nan=True, rtol=1e-11)
    np.testing.assert_allclose(whole["previous_high_20"], close.rolling(20).max().shift(), equal_nan=True)


def test_a_constant_series_stays_constant():
    f = walk(400).assign(close=0.1 + 99.9, high=101.0, low=99.0, volume=5e6)
    got = cut_up(f, spread.Features(), [3, 17, 18, 90, 91, 250])
    assert (got["ema20"] == f["close"]).all() and (got["ema50"] == f["close"]).all()
    assert (got["sma20"].dropna() == f["close"].iloc[0]).all() and (got["atr14"].dropna() == 2.0).all()


def test_a_missing_range_ends_the_average_in_all_later_chunks():
    f = walk(120)
    f.loc[40, ["high", "low"]] = np.nan
    got = cut_up(f, spread.Features(), [30, 60, 100])
    assert got["atr14"].iloc[13:40].notna().all() and got["atr14"].iloc[40:].isna().all()


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_features_equal_those_of_one_task(spark, partitions):
    frames = [walk(n, k, 0.1).assign(symbol=s) for k, (s, n) in enumerate([("A", 700), ("B", 3), ("C", 90), ("D", 1)])]
    bars = spark.createDataFrame(pd.concat(frames))
    bars = bars.select("date", "symbol", *(F.nanvl(c, F.lit(None)).alias(c) for c in ("open", "high", "low", "close", "volume")))
    key = ["symbol", "date"]
    want = features.features(bars).toPandas().sort_values(key).reset_index(drop=True)
    got = spread.features(bars, partitions=partitions).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, rtol=1e-9, check_dtype=False)


def test_no_rows(spark):
    bars = spark.createDataFrame([], "date date, symbol string, open double, high double, low double, close double, volume double")
    assert spread.features(bars).collect() == []


def test_one_symbol_of_a_million_bars_is_spread_over_tasks(spark):
    n = 1_000_000
    i = F.col("id")
    close = 100 + 10 * F.sin(i / 977.0) + (i * 7919 % 101) / 50.0
    bars = spark.range(n).select(
        F.timestamp_seconds(i * 60).alias("date"), F.lit("HOT").alias("symbol"), close.alias("open"), (close + 1 + i % 3).alias("high"), (close - 1 - i % 2).alias("low"), close.alias("close"), (1000.0 + i % 977).alias("volume")
    )
    sizes = chunks(bars, "symbol", "date", partitions=12).groupBy(CHUNK).count().collect()
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) < n / 4
    got = spread.features(bars, partitions=12)
    k = np.arange(n)
    price = 100 + 10 * np.sin(k / 977.0) + (k * 7919 % 101) / 50.0
    f = pd.DataFrame({"high": price + 1 + k % 3, "low": price - 1 - k % 2, "close": price, "volume": 1000.0 + k % 977})
    whole = spread.Features().apply(None, f)
    got = got.persist()
    last = got.orderBy(F.desc("date")).limit(3).toPandas().sort_values("date")
    for c in spread.ADDED:
        np.testing.assert_allclose(last[c], whole[c].iloc[-3:], rtol=1e-9, err_msg=c)
    sums = got.agg(*(F.sum(c).alias(c) for c in spread.ADDED), F.count("*").alias("n")).first()
    assert sums.n == n
    for c in spread.ADDED:
        assert abs(sums[c] - np.nansum(whole[c])) <= 1e-9 * np.nansum(np.abs(whole[c])), c
    got.unpersist()
    curve = bars.select("symbol", F.lit("full").alias("run_id"), "date", F.col("close").alias("equity"))
    low = spread.drawdown(curve, partitions=12).agg(F.min("drawdown").alias("d"), F.max("peak").alias("p")).first()
    peak = np.maximum.accumulate(f["close"])
    assert low.d == pytest.approx(((f["close"] - peak) / peak).min(), rel=1e-9) and low.p == pytest.approx(peak.max(), rel=1e-12)


def test_drawdown_equals_that_of_one_task(spark):
    r = np.random.default_rng(3)
    rows = [(s, run, f"2020-{1 + k // 28:02d}-{1 + k % 28:02d}", float(r.integers(0, 50)) if k % 9 else None) for s in "AB" for run in ("x", "y") for k in range(80)]
    curve = spark.createDataFrame(rows, "symbol string, run_id string, date string, equity double")
    key = ["symbol", "run_id", "date"]
    want = metrics.drawdown(curve).toPandas().sort_values(key).reset_index(drop=True)
    got = spread.drawdown(curve, partitions=7).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_steps_equal_those_of_one_task(spark):
    r = np.random.default_rng(5)
    rows = []
    for s, n in (("A", 300), ("B", 1), ("C", 40)):
        for k in range(n):
            date = None if k % 17 == 0 else f"2020-{1 + int(r.integers(0, 12)):02d}-{1 + int(r.integers(0, 28)):02d}"
            rows.append((s, k, date, float(r.integers(0, 4)) if k % 7 else None, float(r.normal(0, 0.5)) if k % 5 else None, float(r.integers(-1, 3))))
    bars = spark.createDataFrame(rows, "symbol string, _src_row long, date string, close double, change_pct_src double, volume double")
    bars = bars.withColumns({"date": F.col("date").cast("date"), "open": F.col("close"), "high": F.col("close"), "low": F.col("close")})
    key = ["symbol", "_src_row"]
    columns = [*key, "backward", "computed", "difference"]
    want = quality._stepped(bars).select(*columns).toPandas().sort_values(key).reset_index(drop=True)
    got = spread.stepped(bars, 6).select(*columns).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    one, other = quality.report(bars), quality.report(bars, stepped=lambda b: spread.stepped(b, 6))
    assert sorted(map(str, one.select(*sorted(one.columns)).collect())) == sorted(map(str, other.select(*sorted(one.columns)).collect()))
    assert {r.symbol: r.n_backward for r in other.collect()}["A"] > 0


def test_steps_of_one_hot_symbol(spark):
    n = 1_000_000
    i = F.col("id")
    bars = spark.range(n).select(F.lit("HOT").alias("symbol"), i.alias("_src_row"), F.timestamp_seconds(F.floor(i / 2) * 60).alias("date"), (1 + i % 2).cast("double").alias("close"), F.lit(1.0).alias("change_pct_src"))
    done = spread.stepped(bars, 12)
    assert done.rdd.getNumPartitions() >= 8
    x = done.agg(F.count_if("backward").alias("back"), F.count_if(F.col("difference") > 0.005).alias("off"), F.count("*").alias("n")).first()
    assert (x.n, x.back, x.off) == (n, n // 2, n // 2 - 1)  # every second row doubles, the others halve


@pytest.mark.parametrize("keep_last", [True, False])
def test_downsampling_equals_that_of_one_task(spark, keep_last):
    rows = [(s, f"2020-{1 + k // 28:02d}-{1 + k % 28:02d}", float(k) if k % 5 else None) for s, n in (("A", 200), ("B", 3), ("C", 41)) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, date string, close double")
    got = spread.downsample(df, 40, "close", keep_last, 7)
    assert sorted(map(str, got.collect())) == sorted(map(str, query.downsample(df, 40, keep_last).select("symbol", "date", "close").collect()))
