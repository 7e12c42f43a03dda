"""The kernels on hand-made bars."""

import math

import numpy as np
import pandas as pd
import pytest

from ledgerline.operators import kernels as k

FREE = k.Config(slippage_rate=0.0, commission_rate=0.0)


def bars(*rows, long=(0,), emas=None):
    """Rows of (open, high, low, close); day 1 is the signal bar."""
    every = [(99, 101, 97, 99), *rows]
    n, column = len(every), lambda k: [float(r[k]) for r in every]
    return k.Bars([f"2024-01-{i + 1:02d}" for i in range(n)], list(range(n)), column(0), column(2), column(3), [(emas or {}).get(i, math.nan) for i in range(n)], [2.0] * n, [i in long for i in range(n)])


def run(b, config=FREE):
    done = k.simulate(b, config)
    return {"trade": done.trades, "skip": done.skips, "cash": done.cash, "quantity": done.quantity}


ENTRY = (100, 102, 98, 101)


@pytest.mark.parametrize(
    ("rows", "emas", "reason", "date", "price"),
    [
        ([ENTRY, (98, 99, 95, 97)], None, k.STOP_LOSS, "2024-01-03", 96),
        ([ENTRY, (93, 95, 91, 94)], None, k.STOP_GAP, "2024-01-03", 93),
        ([(100, 102, 95, 101), (100, 101, 99, 100)], None, k.STOP_LOSS, "2024-01-02", 96),
        ([ENTRY, (100, 101, 98, 99), (98, 99, 97, 98), (98, 99, 97, 98)], {2: 100.0}, k.TREND_EXIT, "2024-01-04", 98),
        ([ENTRY, (100, 101, 98, 99), (93, 94, 90, 92)], {2: 100.0}, k.STOP_GAP, "2024-01-04", 93),
        ([ENTRY, (110, 113, 109, 112)], None, k.END_OF_DATA, "2024-01-03", 112),
    ],
)
def test_exits(rows, emas, reason, date, price):
    (t,) = run(bars(*rows, emas=emas))["trade"]
    assert (t[12], t[9], t[10]) == (reason, date, price)
    assert (t[3], t[5], t[7]) == (100, 96, 250)


def test_skips():
    assert run(bars(long=(0,)))["skip"][0][1] == k.NO_NEXT_DAY
    held = run(bars(ENTRY, (101, 103, 100, 102), long=(0, 2)))
    assert [s[1] for s in held["skip"]] == [k.NO_NEXT_DAY]  # the last bar sells before its signal is looked at
    b = bars(ENTRY)
    b.atr14[0] = math.nan
    assert run(b)["skip"][0][1] == k.ZERO_ATR
    b = bars(ENTRY)
    b.atr14[0] = 5000.0
    assert run(b)["skip"][0][1] == k.ZERO_QTY
    b = bars(ENTRY)
    b.open[1] = math.nan
    assert run(b)["skip"][0][1] == k.NO_PRICE


def test_in_position_is_skipped_and_reentry_follows_a_stop():
    out = run(bars(ENTRY, (101, 102, 99, 101), (101, 102, 100, 101), long=(0, 2)))
    assert [s[1] for s in out["skip"]] == [k.IN_POSITION] and len(out["trade"]) == 1
    again = run(bars(ENTRY, (98, 99, 95, 97), (97, 99, 96, 98), (99, 100, 98, 99), long=(0, 3)))
    assert len(again["trade"]) == 2


def test_costs_and_equity():
    c = k.Config(slippage_rate=0.001, commission_rate=0.002)
    out = run(bars(ENTRY, (110, 113, 109, 112)), c)
    (t,) = out["trade"]
    bought, sold, n = 100 * 1.001, 112 * 0.999, t[7]
    assert t[15] == pytest.approx((sold - bought) * n - (bought + sold) * n * 0.002)
    assert out["cash"][-1] == pytest.approx(100_000 + t[15]) and out["quantity"][-1] == 0
    # The signal bar shows the position bought at the next open.
    assert out["quantity"][0] == n


def test_future_bars_change_no_earlier_row():
    rng = np.random.default_rng(1)
    walk = 100 + np.cumsum(rng.normal(0, 1, 150))


    def done(c):
        n = len(c)
        return k.simulate(k.Bars([f"{i:04d}" for i in range(n)], list(range(n)), list(c), list(c - 1), list(c + 0.2), [math.nan] * n, [2.0] * n, [i % 30 == 21 for i in range(n)]), FREE)

    short, longer = done(walk), done(np.concatenate([walk, walk[-1] * np.array([5, 0.1, 9.0])]))
    assert (short.cash[:148] == longer.cash[:148]).all() and (short.quantity[:148] == longer.quantity[:148]).all()


@pytest.mark.parametrize("bad", [{"initial_capital": 0}, {"risk_per_trade": 0}, {"risk_per_trade": 1.5}, {"atr_multiplier": 0}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        k.Config(**bad)


def test_ema_gaps_and_wilder():
    assert k.ema(pd.Series([1, None, None, 4, 5.0]), 3).round(6).tolist() == [1, 1, 1, 3.4, 4.2]
    with pytest.raises(ValueError):
        k.ema(pd.Series([1.0]), 0)
    r = np.arange(1.0, 21.0)
    out = k.wilder(r)
    assert np.isnan(out[:13]).all() and out[13] == pytest.approx(r[:14].mean())
    assert out[14] == pytest.approx(out[13] * 13 / 14 + 15 / 14)
    assert np.isnan(k.wilder(r[:13])).all()
    r[15] = np.nan
    assert np.isnan(k.wilder(r)[15:]).all()
    with pytest.raises(ValueError):
        k.wilder(r, 0)


def test_stream_step_equals_batch():
    from ledgerline.streaming.bars import step

    rng = np.random.default_rng(0)
    close = 100 + np.cumsum(rng.normal(0, 1, 60))
    high, low = close + 1, close - 1
    before = np.concatenate([[np.nan], close[:-1]])
    ranges = np.nanmax(np.stack([high - low, abs(high - before), abs(low - before)]), axis=0)
    state, got = None, []
    for h, lo, c in zip(high, low, close):
        state = step(state, h, lo, c)
        got.append(state)
    assert np.allclose([g[0] for g in got], k.ema(pd.Series(close), 20))
    want = k.wilder(ranges)
    assert all(math.isnan(g[3]) == math.isnan(w) and (math.isnan(w) or abs(g[3] - w) < 1e-9) for g, w in zip(got, want))
