"""The symbol catalog and its paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Symbol:
    symbol: str
    raw_file: str
    description: str


#: The symbols a user can ask for.
SYMBOLS = {
    s.symbol: s
    for s in (
        Symbol("ITC", "ITC Stock Price History.csv", "ITC Ltd — NSE (ITC.NS)"),
        Symbol("RELIANCE", "RELIANCE.csv", "Reliance Industries Ltd — NSE (RELIANCE.NS)"),
        Symbol("TCS", "TCS.csv", "Tata Consultancy Services Ltd — NSE (TCS.NS)"),
        Symbol("INFY", "INFY.csv", "Infosys Ltd — NSE (INFY.NS)"),
        Symbol("HDFCBANK", "HDFCBANK.csv", "HDFC Bank Ltd — NSE (HDFCBANK.NS)"),
    )
}


class DataNotAvailable(Exception):
    """The symbol is known but has no data yet."""


def symbol_config(symbol: str, catalog: dict[str, Symbol] = SYMBOLS) -> Symbol:
    """KeyError for an unknown symbol."""
    return catalog[symbol]


def paths(root: str, symbol: str, catalog: dict[str, Symbol] = SYMBOLS) -> dict[str, str]:
    s = symbol_config(symbol, catalog)
    return {
        "raw": f"{root}/raw/stocks/{s.raw_file}",
        "bars": f"{root}/processed/stocks/symbol={symbol}",
        "features": f"{root}/features/stocks/symbol={symbol}",
        "backtest": f"{root}/backtests/{symbol}",
        "quality_json": f"{root}/reports/stocks/{symbol}_data_quality.json",
        "quality_markdown": f"{root}/reports/stocks/{symbol}_data_quality.md",
    }


def catalog_table(spark: SparkSession, catalog: dict[str, Symbol] = SYMBOLS) -> DataFrame:
    return spark.createDataFrame([(s.symbol, s.raw_file, s.description) for s in catalog.values()], "symbol string, raw_file string, description string")


def derived(bars: DataFrame) -> DataFrame:
    """A catalog of the symbols of bars: (symbol, raw_file, description), and how many bars each has."""
    return bars.groupBy(F.upper("symbol").alias("symbol")).agg(F.count("*").alias("n_bars")).select("symbol", F.concat("symbol", F.lit(".csv")).alias("raw_file"), F.concat(F.lit("bars of "), "symbol").alias("description"), "n_bars")


def available(bars: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows whose symbol has bars, by symbol."""
    return catalog.join(bars.select("symbol").distinct(), "symbol", "left_semi").orderBy("symbol")


def guard(bars: DataFrame, symbol: str, catalog: dict[str, Symbol] | None = SYMBOLS) -> str:
    """The key of a symbol in any case; KeyError if unknown, DataNotAvailable without bars."""
    key = symbol.upper()
    if catalog is not None and key not in catalog:
        raise KeyError(symbol)
    if bars.where(F.col("symbol") == key).isEmpty():
        raise DataNotAvailable(symbol)
    return key
