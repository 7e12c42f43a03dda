"""Raw vendor rows to canonical bars: parse, deduplicate, report; nothing is dropped silently."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.parse import blank_to_null, parse_change_pct, parse_date, parse_price, parse_volume, trim_strings
from ledgerline.schemas import RAW_COLUMNS

ROW = "_src_row"
#: Source column -> (canonical name, parser).
FIELDS = {"Date": ("date", parse_date), "Price": ("close", parse_price), "Open": ("open", parse_price), "High": ("high", parse_price), "Low": ("low", parse_price), "Vol.": ("volume", parse_volume), "Change %": ("change_pct_src", parse_change_pct)}
#: Columns whose absence is a warning; that of a price is an error, and no date is no table.
OPTIONAL = {"Vol.": "no column Vol.: volume is null", "Change %": "no column Change %: changes are not checked"}


def source(column: str) -> str:
    """A raw column's name beside the canonical ones, which differ from some only by case."""
    return f"source {column}"


@dataclass
class Cleaned:
    """bars: the canonical rows with change_pct_src and the source row; issues: what was found;
    counts: one row per symbol; warnings and errors: about columns that the source lacks."""

    bars: DataFrame
    issues: DataFrame
    counts: DataFrame
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def absent(columns: list[str]) -> tuple[list[str], list[str]]:
    """(warnings, errors) about the source columns that are not there; ValueError without a date."""
    gone = [c for c in RAW_COLUMNS if c not in columns]
    if "Date" in gone:
        raise ValueError("clean: missing column Date")
    return [OPTIONAL[c] for c in gone if c in OPTIONAL], [f"no column {c}" for c in gone if c not in OPTIONAL]


def numbered(raw: DataFrame) -> DataFrame:
    """Rows with their place in the source. Only right after a scan, in file order."""
    return raw if ROW in raw.columns else raw.withColumn(ROW, F.monotonically_increasing_id())


def prepared(raw: DataFrame, symbol: str | None) -> DataFrame:
    """Trimmed strings, blanks as null, all seven columns, a symbol column."""
    absent(raw.columns)
    df = raw if "symbol" in raw.columns else raw.withColumn("symbol", F.lit(symbol))
    df = trim_strings(df.select("symbol", ROW, *(f"`{c}`" if c in df.columns else F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS)))
    return df.select("symbol", ROW, *(blank_to_null(F.col(f"`{c}`")).alias(source(c)) for c in RAW_COLUMNS))


def distinct_rows(df: DataFrame) -> DataFrame:
    """A row for each set of rows that are equal in every source string: the first one's place, and how many
    they are (copies). Tasks combine before the shuffle, so a row repeated without end is no hot key."""
    return df.groupBy("symbol", *(f"`{source(c)}`" for c in RAW_COLUMNS)).agg(F.min(ROW).alias(ROW), F.count("*").alias("copies"))


def parsed(df: DataFrame) -> DataFrame:
    return df.withColumns({name: parse(F.col(f"`{source(c)}`")) for c, (name, parse) in FIELDS.items()})


def _unread_count():
    """How many strings of a parsed row say nothing."""
    return reduce(add, ((F.col(f"`{source(c)}`").isNotNull() & F.col(n).isNull()).cast("long") for c, (n, _) in FIELDS.items()))


def first_of_dates(rows: DataFrame) -> DataFrame:
    """Of the parsed distinct rows of a date the first in the source, with how many they are (of_date) and
    all their copies and unreadable strings. Rows without a date stand each alone. Combined before the shuffle, too."""
    alone = F.when(F.col("date").isNull(), F.col(ROW)).alias("alone")
    values = [n for n, _ in FIELDS.values() if n != "date"]
    return rows.groupBy("symbol", "date", alone).agg(*(F.min_by(n, ROW).alias(n) for n in values), F.min(ROW).alias(ROW), F.count("*").alias("of_date"), F.sum("copies").alias("copies"), F.sum(_unread_count()).alias("unread")).drop("alone")


def _issue(row, field_: str, value, reason, action: str):
    parts = {"row_index": row, "field": F.lit(field_), "raw_value": value, "reason": reason, "action": F.lit(action)}
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def _issues(df: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """What was found: copies and further rows of a date, each at its place, which is a key without
    repeats; dates and symbols that had them; and what couldn't be parsed."""
    row, none, day = F.col(ROW), F.lit(None).cast("long"), F.col("date").cast("string")
    unread = [F.when(F.col(f"`{source(c)}`").isNotNull() & F.col(n).isNull(), _issue(row, c, F.col(f"`{source(c)}`"), F.lit("unparseable"), "reported")) for c, (n, _) in FIELDS.items()]
    each = rows.select("symbol", F.explode(F.filter(F.array(*unread), lambda x: x.isNotNull())).alias("issue"))
    place = ["symbol", ROW]
    copies = df.join(rows.select(*place), place, "left_anti").select("symbol", _issue(row, "row", F.col(f"`{source('Date')}`"), F.lit("exact duplicate"), "removed").alias("issue"))
    later = rows.where("date is not null").join(kept.select(*place), place, "left_anti").select("symbol", _issue(row, "row", day, F.lit("duplicate date"), "removed").alias("issue"))
    dates = kept.where("of_date > 1").select("symbol", _issue(none, "Date", day, F.format_string("date of %d rows", "of_date"), "removed").alias("issue"))
    repeated = rows.groupBy("symbol").agg(F.sum(F.col("copies") - 1).alias("n")).where("n > 0")
    summary = repeated.select("symbol", _issue(none, "row", F.lit(None).cast("string"), F.format_string("%d exact duplicates", "n"), "removed").alias("issue"))
    return reduce(DataFrame.unionByName, (each, copies, later, dates, summary)).select("symbol", "issue.*")


def clean(raw: DataFrame, symbol: str | None = None) -> Cleaned:
    """Bars, issues and counts; places of rows are unique within a symbol. No window, no group of rows:
    duplicates are aggregations that combine before they shuffle."""
    warnings, errors = absent(raw.columns)
    df = prepared(numbered(raw), symbol)
    rows = parsed(distinct_rows(df))
    kept = first_of_dates(rows)
    bars = kept.select("date", "symbol", "open", "high", "low", "close", "volume", "change_pct_src", ROW)
    n, distinct = F.count("*"), F.sum("of_date")
    counts = kept.groupBy("symbol").agg(
        F.sum("copies").alias("original_rows"),
        (F.sum("copies") - distinct).alias("exact_duplicates"),
        F.count_if(F.col("of_date") > 1).alias("duplicate_dates"),
        (distinct - n).alias("duplicate_date_rows"),
        n.alias("final_rows"),
        F.sum("unread").alias("unread"),
    )
    # As many as there are rows of issues: each of these, and one for a symbol with exact duplicates.
    issues = F.col("unread") + F.col("exact_duplicates") + (F.col("exact_duplicates") > 0).cast("long") + F.col("duplicate_dates") + F.col("duplicate_date_rows")
    counts = counts.withColumn("removed_rows", F.col("original_rows") - F.col("final_rows")).withColumn("n_issues", issues).drop("unread")
    return Cleaned(bars, _issues(df, rows, kept), counts, warnings, errors)
