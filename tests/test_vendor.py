"""Vendor files of many symbols: one scan, reports, digests and the data source."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.clean import ROW
from ledgerline.schemas import RAW_COLUMNS
from ledgerline.sources import vendor

HEAD = "Date,Price,Open,High,Low,Vol.,Change %"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "with space").mkdir()
    texts = {
        "AAA": (tmp_path / "with space/a b.csv", "﻿" + HEAD + "\n01/02/2024, 1.5,1,2,1,1M,0.5%\n\n01/03/2024,\"1,234.5\",1,2,1,-,\n"),
        "BBB": (tmp_path / "b.csv", "Change %,Date,Note,Price\n1%,01/02/2024,x,7\n"),
        "CCC": (tmp_path / "c.csv", HEAD + "\n" + "".join(f"{1 + k % 12:02d}/01/{2000 + k // 12},{k}.00,1,2,0,1K,1%\n" for k in range(5000))),
    }
    for path, text in texts.values():
        path.write_text(text, encoding="utf-8")
    return {s: str(p) for s, (p, _) in texts.items()}


def rows_of(df, symbol):
    return [tuple(r[c] for c in RAW_COLUMNS) for r in df.where(F.col("symbol") == symbol).orderBy(ROW).collect()]


def test_one_scan_reads_all_files(spark, files):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))  # a file is split over tasks
    try:
        got = vendor.scan_all(spark, files)
        assert rows_of(got.rows, "AAA") == [("01/02/2024", "1.5", "1", "2", "1", "1M", "0.5%"), ("01/03/2024", "1,234.5", "1", "2", "1", "-", None)]
        assert rows_of(got.rows, "BBB") == [("01/02/2024", "7", None, None, None, None, "1%")]
        assert [r[1] for r in rows_of(got.rows, "CCC")] == [f"{k}.00" for k in range(5000)]
        assert got.rows.select(F.input_file_name()).distinct().count() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    told = {r.symbol: r for r in got.reports.collect()}
    for s, path in files.items():
        raw = open(path, "rb").read()
        assert (told[s].sha256, told[s].bytes) == (hashlib.sha256(raw).hexdigest(), len(raw))
    assert told["BBB"].warnings == ["unexpected column Note"] and told["BBB"].errors == [f"missing column {c}" for c in ("Open", "High", "Low", "Vol.")]
    assert [told[s].n_rows for s in files] == [2, 1, 5000] and told["AAA"].warnings == told["AAA"].errors == []
    assert vendor.changed(spark, got.reports) == []
    with open(files["BBB"], "a") as f:
        f.write("2%,01/03/2024,y,8\n")
    assert vendor.changed(spark, got.reports) == [files["BBB"]]


def test_long_files_are_digested_as_streams(spark, files, monkeypatch):
    monkeypatch.setattr(vendor, "WHOLE", 100)
    got = {r.symbol: r.sha256 for r in vendor.digests(spark, files).collect()}
    assert got == {s: hashlib.sha256(open(p, "rb").read()).hexdigest() for s, p in files.items()}


def test_missing_and_empty_files(spark, files, tmp_path):
    with pytest.raises(FileNotFoundError):
        vendor.scan_all(spark, files | {"DDD": str(tmp_path / "none.csv")})
    for text in ("", HEAD + "\n"):
        (tmp_path / "e.csv").write_text(text)
        with pytest.raises(ValueError, match="no rows"):
            vendor.scan_all(spark, files | {"DDD": str(tmp_path / "e.csv")})


def test_data_source_reads_what_the_scan_reads(spark, files):
    df, scan = vendor.vendor(spark, files), vendor.scan_all(spark, files)
    for s in files:
        assert rows_of(df, s) == rows_of(scan.rows, s)
    assert df.rdd.getNumPartitions() == 3
    one = vendor.vendor(spark, files | {"NONE": "/no/such/file"}, ["bbb"])
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1  # the other files are not opened
    assert df.where("symbol = 'BBB'").count() == 1 and df.count() == 5003  # no query's filter stays for the next


def test_data_source_without_files(spark):
    with pytest.raises(Exception, match="name a file"):
        spark.dataSource.register(vendor.VendorSource)
        spark.read.format("vendor").load().count()
