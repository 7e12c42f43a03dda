"""Parsing of vendor strings, as column expressions: what doesn't parse is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that stand for a missing value, by kind of column.
NO_VOLUME = ("", "-", "N/A", "n/a", "NA", "na", "null", "NULL")
NO_NUMBER = ("", "-", "N/A", "n/a")
VOLUME = r"^\s*([+-]?\d+(?:\.\d+)?)\s*([KMBkmb])?\s*$"
PERCENT = r"^\s*([+-]?\d+(?:\.\d+)?)\s*%\s*$"
#: What a price may be once its commas are gone: a decimal number, without type suffixes.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^\d{1,2}/\d{1,2}/\d{4}$"


def parse_volume(c: Column) -> Column:
    """21.48M -> 21480000.0; K, M and B in either case; no thousands separators."""
    unit = F.upper(F.regexp_extract(c, VOLUME, 2))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.when(~F.trim(c).isin(*NO_VOLUME) & c.rlike(VOLUME), F.regexp_extract(c, VOLUME, 1).try_cast("double") * scale)


def parse_change_pct(c: Column) -> Column:
    """-0.35% -> -0.0035; the sign % is a must."""
    return F.when(~F.trim(c).isin(*NO_NUMBER) & c.rlike(PERCENT), F.regexp_extract(c, PERCENT, 1).try_cast("double") / 100.0)


def parse_date(c: Column) -> Column:
    """month/day/year, one or two digits for month and day and four for the year."""
    t = F.trim(c)
    return F.when(t.rlike(DATE), F.to_date(F.try_to_timestamp(t, F.lit("M/d/yyyy"))))


def parse_price(c: Column) -> Column:
    """1,234.56 -> 1234.56."""
    t = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(~t.isin(*NO_NUMBER) & t.rlike(NUMBER), t.try_cast("double"))


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(*(F.trim(f.name if f.name.isidentifier() else f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def days_between(start: Column, end: Column) -> Column:
    """Calendar days, not below 0; 0 where either is missing."""
    return F.greatest(F.lit(0), F.coalesce(F.datediff(end, start), F.lit(0)))


def symbol_key(c: Column) -> Column:
    return F.upper(c)


#: Splits a double into two halves of at most 27 bits.
_HALF = float(2**27 + 1)


def rounded(c: Column, digits: int = 6) -> Column:
    """The nearest decimal with so many digits, by the exact binary value, ties to even: the rounding of
    ledgers and summaries, and of every query. The scaled value alone is rounded to the next double and
    may fall on a tie; what it lost then decides."""
    scale = float(10**digits)
    scaled = c * scale
    whole = F.rint(scaled)
    high = c * _HALF - (c * _HALF - c)
    lost = (high * scale - scaled) + (c - high) * scale  # exact: both products fit a double
    tie = scaled - whole
    return (whole + F.when((tie == 0.5) & (lost > 0), 1.0).when((tie == -0.5) & (lost < 0), -1.0).otherwise(0.0)) / scale
