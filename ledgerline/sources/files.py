"""File sources: vendor CSV, canonical and feature tables, JSON artifacts, digests."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.schemas import BARS, FEATURES, RAW_COLUMNS


@dataclass
class SourceReport:
    """What a scan found out about its file."""

    path: str
    columns: list[str]
    rows: int = 0
    sha256: str = ""
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


def sha256_of(spark: SparkSession, path: str) -> str:
    """The digest of one file of any size: a digest has no parallel form, so one stream is read in
    small pieces, through the file system that Spark reads it by."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(context._jsc.hadoopConfiguration()).open(where)
    try:
        return context._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def unchanged(spark: SparkSession, path: str, sha256: str) -> bool:
    return sha256_of(spark, path) == sha256


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names as the file has them; a byte-order mark before the first is dropped."""
    return [c.lstrip("﻿").strip() for c in spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path).columns]


def scan_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, spaces after a delimiter dropped, nothing read as missing but the
    empty string."""
    names = header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).csv(path)


def load_raw(spark: SparkSession, path: str) -> tuple[DataFrame, SourceReport]:
    """A vendor file and its report: unexpected columns warn, missing ones are errors.

    FileNotFoundError without a file, ValueError for one without rows.
    """
    try:
        df = scan_strings(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from None
        raise ValueError(f"{path}: not readable as CSV") from e
    if df.isEmpty():
        raise ValueError(f"{path}: no rows")
    have = df.columns
    report = SourceReport(path, have, df.count(), sha256_of(spark, path))
    report.warnings += [f"unexpected column {c}" for c in have if c not in RAW_COLUMNS]
    report.errors += [f"missing column {c}" for c in RAW_COLUMNS if c not in have]
    return df, report


class Source(ABC):
    """A place that raw rows of a symbol come from."""

    @abstractmethod
    def load(self, spark: SparkSession, path: str, symbol: str) -> tuple[DataFrame, SourceReport]: ...


class VendorCsv(Source):
    """Vendor CSV: missing columns raise, further ones are tolerated."""

    def load(self, spark: SparkSession, path: str, symbol: str) -> tuple[DataFrame, SourceReport]:
        df, report = load_raw(spark, path)
        if report.errors:
            raise ValueError(f"{path}: {'; '.join(report.errors)}")
        return df.withColumn("symbol", F.lit(symbol.upper())), report


def bars_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Canonical bars, partitioned by symbol; text files are read with the table's types."""
    return _typed(spark, path, BARS, fmt)


def features_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The 21 columns of the feature table, partitioned by symbol."""
    return _typed(spark, path, FEATURES, fmt)


def _typed(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    df = reader.option("header", True).option("enforceSchema", False).csv(path) if fmt == "csv" else reader.parquet(path)
    return df.select(*schema.names)


def signals_only(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Of the feature table, what an overview reads: no other column reaches the scan."""
    return features_table(spark, path, fmt).select("symbol", "date", "signal")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, strict: bool = False) -> DataFrame | None:
    """A JSON artifact; None where it is missing or any of it is broken, unless strict."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    try:
        df = (reader.schema(schema) if schema else reader).json(path)
        df.write.format("noop").mode("overwrite").save()  # a broken record may stand anywhere
        return df
    except Exception:
        if strict:
            raise
        return None


def read_artifact(spark: SparkSession, path: str, whole: bool = False, strict: bool = False) -> DataFrame | None:
    """(symbol, json) of an artifact of one JSON object a line or, with ``whole``, a file. An object that is
    broken or names no symbol counts as absent, beside the others; None where nothing is there. strict: such
    an object raises when it is read, a missing artifact at once."""
    try:
        lines = spark.read.text(path, wholetext=whole).where(F.trim("value") != "")
    except AnalysisException:
        if strict:
            raise
        return None
    doc = F.parse_json("value") if strict else F.try_parse_json("value")
    rows = lines.select(F.try_variant_get(doc, "$.symbol", "string").alias("symbol"), F.to_json(doc).alias("json"))
    return rows.withColumn("symbol", F.coalesce("symbol", F.raise_error(F.lit(f"{path}: an object without a symbol")))) if strict else rows.where("symbol is not null")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet artifact without the files that are broken; None where none is left."""
    try:
        df = spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(path)  # the columns of any good file
    except AnalysisException:
        return None
    return df if "symbol" in df.columns else None
