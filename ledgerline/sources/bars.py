"""Adapters from tables of events and orders to bars, and to vendor-style strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.parse import rounded


def bars_of(rows: DataFrame, symbol: str, time, price, volume, order) -> DataFrame:
    """OHLCV per (symbol, time): open and close by ``order``, a total order inside a bar. The
    aggregation combines before the shuffle, so hot symbols send a row per bar and task."""
    return rows.groupBy(F.col(symbol).alias("symbol"), time.alias("date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), rounded(volume).alias("volume")
    ).select("date", "symbol", "open", "high", "low", "close", "volume")


def bars_events(spark: SparkSession, sf_dir: str, minutes: int = 15) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    return bars_of(e, "event_type", F.window("ts", f"{minutes} minutes")["start"], F.col("value"), F.sum("value"), F.struct("ts", "event_id"))


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    return bars_of(o, "o_orderpriority", F.to_date("o_orderdate"), F.col("o_totalprice") / 1000.0, F.count("*").cast("double"), F.struct("o_orderdate", "o_orderkey"))


def _cents(c) -> object:
    return F.concat((F.floor(c) / 100).cast("long").cast("string"), F.lit("."), F.lpad((F.floor(c) % 100).cast("string"), 2, "0"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a vendor would: all strings, some of them unreadable or missing, some rows
    twice, dates that repeat. The row's place is its event id, or that plus 10**9 for a second copy."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    i, v = F.col("event_id"), F.abs(F.col("value")) * 100
    price = F.when(i % 23 == 0, F.concat(F.lit("1,"), F.lpad(_cents(v % 100000), 6, "0"))).when(i % 29 == 0, "bad").otherwise(_cents(v))
    rows = e.select(
        F.col("event_type").alias("symbol"), i.alias("_src_row"),
        F.when(i % 97 == 0, F.date_format("ts", "yyyy-MM-dd")).when(i % 89 == 0, "").otherwise(F.date_format(F.expr("ts + make_interval(0, 0, 0, cast(event_id % 4000 as int))"), "MM/dd/yyyy")).alias("Date"),
        price.alias("Price"), _cents(v).alias("Open"), _cents(v + i % 7).alias("High"), F.concat(F.lit(" "), _cents(F.greatest(F.lit(0.0), v - i % 5 + F.when(i % 61 == 0, 40.0).otherwise(0.0)))).alias("Low"),
        F.when(i % 17 == 0, "-").when(i % 19 == 0, "N/A").when(i % 31 == 0, "1,234").otherwise(F.concat(_cents(v), F.element_at(F.array(F.lit("K"), F.lit("M"), F.lit("B"), F.lit("")), (i % 4 + 1).cast("int")))).alias("Vol."),
        F.when(i % 37 == 0, "0.5").otherwise(F.concat(F.when(i % 2 == 0, "-").otherwise(""), _cents(F.floor(F.col("value")) % 900), F.lit("%"))).alias("Change %"),
    )
    return rows.unionByName(rows.where("_src_row % 50 = 0").withColumn("_src_row", F.col("_src_row") + 1_000_000_000))
