"""Running sums over rows in a global order, in two passes over range partitions.

``ordered`` writes the rows sorted once. A first pass sums each partition, or what of it belongs to the
key that goes on beyond its end; the driver adds up these sums, a few numbers a partition; a second pass
adds what stood before. No key is one task's group, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, lean


#: The column that ``ordered`` adds: the number of a row's partition. A task's own number is another
#: one where the rows are read as a part of a union.
PART = "part_id"


def ordered(spark: SparkSession, df: DataFrame, *order: str | Column) -> DataFrame:
    """df range-partitioned and sorted by ``order``, with PART, written to the shared folder: its
    partitions and their rows then stay as they are."""
    return cut(spark, df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()))


def part_of(b: pa.RecordBatch) -> int:
    return b.column(PART)[0].as_py()


def carried(df: DataFrame, key: str | None, sums: Callable[[pa.RecordBatch], np.ndarray], width: int) -> dict[int, tuple[object, list[int]]]:
    """By partition of ``ordered`` rows: the key that its rows begin after, and the ``width`` sums
    (modulo 2**64) of that key's rows before it. Without a key, those of all rows before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        total, part = np.zeros(width, np.uint64), None
        for b in batches:
            if not b.num_rows:
                continue
            values, part = sums(b), part_of(b)
            if key is None:
                total += values.sum(axis=0, dtype=np.uint64)
                continue
            keys = b.column(key).to_numpy(zero_copy_only=False)
            first = int(keys[0]) if first is None else first
            same = keys == keys[-1]
            if last != keys[-1]:
                total = np.zeros(width, np.uint64)
            last = int(keys[-1])
            total = total + values[same].sum(axis=0, dtype=np.uint64)
        if part is not None:
            columns = [[part], [first], [last], [total.view(np.int64).tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["part", "first", "last", "total"])

    parts = sorted(df.mapInArrow(run, "part long, first long, last long, total array<long>").collect())
    out: dict[int, tuple[object, list[int]]] = {}
    at, before = None, np.zeros(width, np.uint64)
    for r in parts:
        out[r.part] = (at, before.view(np.int64).tolist())
        total = np.array(r.total, np.int64).view(np.uint64)
        # A partition whose rows are all of the key that went on before adds to it.
        before = before + total if key is None or r.first == r.last == at else total
        at = r.last
    return out


def running(df: DataFrame, key: str | None, sums: Callable[[pa.RecordBatch], np.ndarray], width: int, emit: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """emit(batch, values, running sums) of each batch of ``ordered`` rows: the sums up to and with each
    row, over its key's rows or, without a key, over all. ``key`` is a column of longs without nulls."""
    before = carried(df, key, sums, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = total = None
        for b in batches:
            if not b.num_rows:
                continue
            if total is None:
                at, total = before[part_of(b)]
                total = np.array(total, np.int64).view(np.uint64)
            values = sums(b)
            all_sums = np.cumsum(values, axis=0, dtype=np.uint64)
            if key is None:
                out = all_sums + total
                total = out[-1].copy()
            else:
                keys = b.column(key).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                size = np.diff(np.append(starts, len(keys)))
                base = np.where(starts[:, None] > 0, all_sums[starts - 1], np.uint64(0))
                if keys[0] == at:
                    base[0] = np.zeros(width, np.uint64) - total
                out = all_sums - np.repeat(base, size, axis=0)
                at, total = int(keys[-1]), out[-1].copy()
            yield emit(b, values, out)

    return df.mapInArrow(lean(run), schema)
