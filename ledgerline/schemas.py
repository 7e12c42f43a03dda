"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_COLUMNS = ("Date", "Price", "Open", "High", "Low", "Vol.", "Change %")
RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

BAR_COLUMNS = ("date", "symbol", "open", "high", "low", "close", "volume")
BARS = T.StructType([T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS[2:])])

FEATURE_COLUMNS = ("ema20", "ema50", "sma20", "sma50", "atr14", "avg_volume_20", "volume_ratio", "momentum_5", "momentum_20")
CONDITIONS = ("trend_condition", "price_condition", "breakout_condition", "volume_condition")
SIGNAL_COLUMNS = (*BAR_COLUMNS, *FEATURE_COLUMNS, *CONDITIONS, "signal")
FEATURES = T.StructType([*BARS.fields, *(T.StructField(c, T.DoubleType()) for c in FEATURE_COLUMNS), *(T.StructField(c, T.BooleanType()) for c in CONDITIONS), T.StructField("signal", T.StringType())])

TRADE_FIELDS = (
    ("trade_id", "long"), ("signal_date", "string"), ("entry_date", "string"), ("entry_reference_price", "double"), ("entry_price", "double"), ("initial_stop", "double"), ("atr_at_signal", "double"), ("quantity", "long"), ("risk_budget", "double"),
    ("exit_date", "string"), ("exit_reference_price", "double"), ("exit_price", "double"), ("exit_reason", "string"), ("gross_pnl", "double"), ("transaction_cost", "double"), ("net_pnl", "double"), ("return_pct", "double"), ("r_multiple", "double"), ("holding_days", "long"),
)
EQUITY_FIELDS = (("date", "string"), ("cash", "double"), ("position_quantity", "long"), ("position_market_value", "double"), ("equity", "double"))
SKIP_FIELDS = (("signal_date", "string"), ("reason", "string"), ("detail", "string"))
SPAN_FIELDS = (("start_date", "string"), ("end_date", "string"), ("first_open", "double"), ("last_close", "double"), ("n", "long"))
CONFIG_FIELDS = (("run_id", "string"), ("initial_capital", "double"), ("risk_per_trade", "double"), ("atr_multiplier", "double"), ("slippage_rate", "double"), ("commission_rate", "double"))


def ddl(fields) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)
