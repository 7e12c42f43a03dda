"""Scans along a key's rows in order, of which one key may have any number.

Rows are dealt to range partitions by key and order, so a hot key is spread over as many tasks as its rows
need, and written once: a partition and its rows then stay as they are, also where an executor is lost. A
scan has three parts. ``summarize`` says of a chunk (one key's rows in one partition) what the rows after it
need; ``advance`` takes a state over a chunk by its summary alone; ``apply`` gives a chunk's result from
the state before it. Only the last key of a partition can go on in the next one, so the driver gets one
summary a partition, advances the states along them, and sends each partition the one it begins with.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "chunk_id"


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A session of one machine takes one of its own where that
    is unset; on a cluster that is an error, as executors don't share it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="ledgerline-checkpoint-")
        context.setCheckpointDir(where)
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def chunks(df: DataFrame, *order: str | Column, partitions: int | None = None) -> DataFrame:
    """df range-partitioned and sorted by ``order`` (keys first), with CHUNK, the partition's number.
    Without ``partitions`` Spark sizes them."""
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return written(dealt.sortWithinPartitions(*order).withColumn(CHUNK, F.spark_partition_id()))


class Scan(ABC):
    """State and summaries are small picklable values; None is the state before a key's first row."""

    @abstractmethod
    def summarize(self, rows: pd.DataFrame) -> Any: ...

    @abstractmethod
    def advance(self, state: Any, summary: Any) -> Any: ...

    @abstractmethod
    def apply(self, state: Any, rows: pd.DataFrame) -> pd.DataFrame: ...


def _by_key(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The chunks of a partition, of which one is held at a time."""
    key, parts = None, []
    for frame in frames:
        if frame.empty:
            continue
        new = np.ones(len(frame), bool)
        new[1:] = (frame[keys].iloc[1:].to_numpy() != frame[keys].iloc[:-1].to_numpy()).any(axis=1)
        starts = [*np.flatnonzero(new).tolist(), len(frame)]
        for a, b in zip(starts[:-1], starts[1:]):
            own = tuple(frame[keys].iloc[a])
            if own != key and parts:
                yield key, pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
                parts = []
            key = own
            parts.append(frame.iloc[a:b])
    if parts:
        yield key, pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)


def scan(sorted_: DataFrame, keys: list[str], along: Scan, schema: T.StructType | str) -> DataFrame:
    """along.apply() of every chunk of ``chunks``; keys are its first columns, and no key is null."""

    def summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = rows = None
        for last, rows in _by_key(frames, keys):
            first = last if first is None else first
        if rows is not None:
            yield pd.DataFrame({"part": [int(rows[CHUNK].iloc[0])], "first": [pickle.dumps(first)], "last": [pickle.dumps(last)], "summary": [pickle.dumps(along.summarize(rows))]})

    parts = sorted(sorted_.mapInPandas(summaries, "part long, first binary, last binary, summary binary").collect(), key=lambda r: r.part)
    before, key, state = {}, None, None
    for r in parts:
        before[r.part] = (key, state)
        first, last, summary = (pickle.loads(bytes(x)) for x in (r.first, r.last, r.summary))
        state = along.advance(state if first == last == key else None, summary)
        key = last
    known = sorted_.sparkSession.sparkContext.broadcast(before)  # one state a partition

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = None
        for own, rows in _by_key(frames, keys):
            if start is None:
                start = known.value[int(rows[CHUNK].iloc[0])]
            yield along.apply(start[1] if own == start[0] else None, rows.drop(columns=CHUNK))
            start = (None, None)

    return sorted_.mapInPandas(run, schema)
