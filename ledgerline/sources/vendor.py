"""Vendor files of many symbols at once: one scan, reports and digests from tasks, and a data source.

``scan_all`` reads every file in one job however many there are: lines with their file and place, of which a
file's first is its header. Headers, a row per file, are all that the driver sees before the rows are
read; a file's columns may stand in any order, lack some or have more. A record is a line: quoted fields
may hold commas, not line ends.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerline.operators.clean import ROW
from ledgerline.schemas import RAW_COLUMNS
from ledgerline.sources.files import sha256_of

#: Files up to this size are digested as one value in a task; longer ones as a stream.
WHOLE = 1 << 30


@dataclass
class Files:
    """rows: (symbol, _src_row, the seven columns as strings); reports: (symbol, path, columns, n_rows, bytes,
    sha256, warnings, errors), a row per file."""

    rows: DataFrame
    reports: DataFrame
    headers: dict[str, list[str]] = field(default_factory=dict)


def _uri(spark: SparkSession, path: str) -> str:
    """The path as a scan names it; FileNotFoundError if nothing is there."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise FileNotFoundError(path)
    return re.sub(r"^(\w+):/+", r"\1:/", system.makeQualified(where).toUri().toString())


def _same(c):
    return F.regexp_replace(c, r"^(\w+):/+", r"$1:/")


def _place():
    """A line's place in its file: the start of its split, and its number in the task, both ascending."""
    return F.shiftleft(F.shiftright("_metadata.file_block_start", 16), 33) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def scan_all(spark: SparkSession, paths: dict[str, str]) -> Files:
    """The files of symbols (symbol -> path); ValueError for one without rows."""
    uris = {s: _uri(spark, p) for s, p in paths.items()}
    lines = spark.read.text(list(paths.values())).select(_same(F.col("_metadata.file_path")).alias("uri"), _place().alias(ROW), "value").where(F.trim("value") != "")
    tops = lines.groupBy("uri").agg(F.min_by("value", ROW).alias("header"), F.min(ROW).alias("top"), (F.count("*") - 1).alias("n_rows"))
    seen = {r.uri: r for r in tops.collect()}  # a row per file
    headers: dict[str, list[str]] = {}
    for symbol, uri in uris.items():
        if uri not in seen or not seen[uri].n_rows:
            raise ValueError(f"{paths[symbol]}: no rows")
        headers[symbol] = [c.strip() for c in next(csv.reader([seen[uri].header], skipinitialspace=True))]
    width = max(len(h) for h in headers.values())
    known = [(s, u, int(seen[u].top), [headers[s].index(c) + 1 if c in headers[s] else None for c in RAW_COLUMNS]) for s, u in uris.items()]
    files = F.broadcast(spark.createDataFrame(known, "symbol string, uri string, top long, places array<int>"))  # a row per file
    cells = F.from_csv("value", ", ".join(f"c{k} string" for k in range(width)), {"ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE"})
    rows = lines.join(files, "uri").where(F.col(ROW) > F.col("top")).withColumn("cells", cells)
    listed = F.array(*(F.col(f"cells.c{k}") for k in range(width)))
    own = [F.get(listed, F.get("places", F.lit(k)) - 1).alias(c) for k, c in enumerate(RAW_COLUMNS)]
    return Files(rows.select(F.upper("symbol").alias("symbol"), ROW, *own), _reports(spark, paths, headers, {s: int(seen[u].n_rows) for s, u in uris.items()}), headers)


def digests(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(symbol, bytes, sha256) of files, each digested in a task."""
    by_uri = {_uri(spark, p): (s, p) for s, p in paths.items()}
    where = F.broadcast(spark.createDataFrame([(s, u) for u, (s, _) in by_uri.items()], "symbol string, uri string"))
    found = spark.read.format("binaryFile").load(list(paths.values()))
    name = _same(F.col("_metadata.file_path"))
    short = found.where(F.col("length") <= WHOLE).select(name.alias("uri"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    sizes = {r.uri: r.length for r in found.where(F.col("length") > WHOLE).select(name.alias("uri"), "length").collect()}
    long = [(u, n, sha256_of(spark, by_uri[u][1])) for u, n in sizes.items()]
    both = short.unionByName(spark.createDataFrame(long, "uri string, bytes long, sha256 string")) if long else short
    return both.join(where, "uri").select(F.upper("symbol").alias("symbol"), "bytes", "sha256")


def _reports(spark: SparkSession, paths: dict[str, str], headers: dict[str, list[str]], n_rows: dict[str, int]) -> DataFrame:
    """What the files are now, a literal row each: later changes are told from it."""
    now = {r.symbol: r for r in digests(spark, paths).collect()}
    told = [
        (s.upper(), paths[s], h, n_rows[s], now[s.upper()].bytes, now[s.upper()].sha256, [f"unexpected column {c}" for c in h if c not in RAW_COLUMNS], [f"missing column {c}" for c in RAW_COLUMNS if c not in h])
        for s, h in headers.items()
    ]
    return spark.createDataFrame(told, "symbol string, path string, columns array<string>, n_rows long, bytes long, sha256 string, warnings array<string>, errors array<string>")


def changed(spark: SparkSession, reports: DataFrame) -> list[str]:
    """The files whose bytes are no longer those of the report."""
    told = {r.symbol: r for r in reports.select("symbol", "path", "sha256").collect()}
    now = {r.symbol: r.sha256 for r in digests(spark, {s: r.path for s, r in told.items()}).collect()}
    return sorted(r.path for s, r in told.items() if now.get(s) != r.sha256)


class VendorFile(InputPartition):
    def __init__(self, symbol: str, path: str):
        self.symbol, self.path = symbol, path


class VendorReader(DataSourceReader):
    """A partition a file. Filters are not pushed here: a reader keeps the files that one query's filter left
    for the next query on the same DataFrame, which then lacks rows. ``vendor`` takes the symbols instead."""

    def __init__(self, files: dict[str, str], names: list[str]):
        self.files, self.names = files, names

    def partitions(self) -> list[VendorFile]:
        return [VendorFile(s, p) for s, p in self.files.items()]

    def read(self, partition: VendorFile) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where = partition.path
        system, path = fs.FileSystem.from_uri(where) if re.match(r"^\w+:/", where) else (fs.LocalFileSystem(), where)
        with system.open_input_stream(path) as raw, io.TextIOWrapper(raw, encoding="utf-8-sig", newline="") as text:
            lines = csv.reader(text, skipinitialspace=True)
            header = [c.strip() for c in next(lines, [])]
            at, rows, n = [header.index(c) if c in header else None for c in self.names[2:]], [], 0
            for cells in lines:
                if not any(c.strip() for c in cells):
                    continue
                rows.append((partition.symbol, n, *(cells[k] or None if k is not None and k < len(cells) else None for k in at)))
                n += 1
                if len(rows) == 4096:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * (len(self.names) - 2)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=self.names)


class VendorSource(DataSource):
    """spark.read.format("vendor").option("TCS", path)...: raw rows of the symbols named, whose files every
    executor can open, by a path or a URI that Arrow knows."""

    @classmethod
    def name(cls) -> str:
        return "vendor"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("symbol", T.StringType()), T.StructField(ROW, T.LongType()), *(T.StructField(c, T.StringType()) for c in RAW_COLUMNS)])

    def reader(self, schema: T.StructType) -> VendorReader:
        files = {s.upper(): p for s, p in self.options.items() if s != "path"}
        if not files:
            raise ValueError("vendor: name a file for each symbol")
        return VendorReader(files, schema.names)


def vendor(spark: SparkSession, files: dict[str, str], symbols: list[str] | None = None) -> DataFrame:
    """The data source's rows; of ``symbols``, if given, whose files alone are opened."""
    spark.dataSource.register(VendorSource)
    wanted = None if symbols is None else {s.upper() for s in symbols}
    return spark.read.format("vendor").options(**{s: p for s, p in files.items() if wanted is None or s.upper() in wanted}).load()
