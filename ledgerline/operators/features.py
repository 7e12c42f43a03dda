"""The feature table and the rule-based signal.

Windows come first and the recursive kernel last, both dealt by symbol, so bars are shuffled
once. Filter symbols before calling: nothing is pushed through the kernel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.indicators import by_symbol, with_windowed
from ledgerline.functions.parse import nan_to_null
from ledgerline.operators.kernels import recursive
from ledgerline.schemas import BAR_COLUMNS, CONDITIONS, SIGNAL_COLUMNS

LONG, NO_SIGNAL = "LONG", "NO_SIGNAL"
VOLUME_FACTOR = 1.5
REQUIRED = ("date", "symbol", "open", "high", "low", "close", "volume")


def require(df: DataFrame, columns: tuple[str, ...], what: str) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{what}: missing columns {missing}")


def features(bars: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """bars with the nine features, true_range and previous_high_20."""
    require(bars, REQUIRED, "features")
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin([s.upper() for s in symbols]))
    wide = with_windowed(bars.select(*BAR_COLUMNS), by_symbol())
    schema = T.StructType([*wide.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("ema20", "ema50", "atr14"))])
    done = wide.groupBy("symbol").applyInPandas(recursive, schema)
    # A frame of pandas has NaN where Spark has null.
    doubles = [f.name for f in schema if isinstance(f.dataType, T.DoubleType)]
    return done.withColumns({c: nan_to_null(F.col(c)) for c in doubles})


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def signals(table: DataFrame, w=None) -> DataFrame:
    """Adds the four conditions and signal; an unknown comparison is false."""
    require(table, ("close", "ema20", "ema50", "volume_ratio"), "signals")
    if "previous_high_20" not in table.columns:
        from ledgerline.functions.indicators import previous_high

        table = table.withColumn("previous_high_20", previous_high(F.col("close"), 20, w or by_symbol()))
    tests = (F.col("ema20") > F.col("ema50"), F.col("close") > F.col("ema20"), F.col("close") > F.col("previous_high_20"), F.col("volume_ratio") > VOLUME_FACTOR)
    out = table.withColumns({n: _sure(t) for n, t in zip(CONDITIONS, tests)})
    every = F.col(CONDITIONS[0]) & F.col(CONDITIONS[1]) & F.col(CONDITIONS[2]) & F.col(CONDITIONS[3])
    return out.withColumn("signal", F.when(every, LONG).otherwise(NO_SIGNAL))


def signal_table(bars: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """The 21 columns in their fixed order."""
    return signals(features(bars, symbols)).select(*SIGNAL_COLUMNS)


def signal_summary(table: DataFrame) -> DataFrame:
    is_long = F.col("signal") == LONG
    return table.groupBy("symbol").agg(
        F.count_if(is_long).alias("n_long"),
        F.count_if(~is_long).alias("n_none"),
        F.min(F.when(is_long, F.col("date"))).alias("first_long"),
        F.max(F.when(is_long, F.col("date"))).alias("last_long"),
    )
