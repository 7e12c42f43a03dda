"""Shared plumbing of the training-data operators.

Rows travel between Spark and Python as Arrow batches, and texts are looked at as one
flat byte buffer per batch with document offsets, so that the inner loops are numpy's.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches: rows and bytes that one batch between the JVM and Python holds at most.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
#: Bytes that are hashed at once.
SLICE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session, so that long texts cannot fill a worker, and let
    finished actions clear their shuffle files. A result is planned when it is read, so this holds
    until untune()."""
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        # Shuffle files go when the action that made them is done; a lost executor's part of a
        # checkpoint is read from the shared folder, not from them.
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    if not hasattr(spark, "_before_tune"):
        spark._before_tune = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)


def untune(spark: SparkSession) -> None:
    """Give the settings that tune() changed the values that they had before."""
    for k, v in getattr(spark, "_before_tune", {}).items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if hasattr(spark, "_before_tune"):
        del spark._before_tune


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write df to the shared folder that spark.checkpoint.dir names, and go on from there.

    Where the setting is empty, a session of one machine, as in tests, takes a folder of its own;
    on a cluster that is an error, as such a folder is another one on each machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="ledgerline-checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives the memory that it freed back to the system when it ends: workers live on
    between tasks and stages, side by side with others."""

    def trimmed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
                trim(0)

    return trimmed


def clean_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): only the two columns an operator reads; a null text is the empty one."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def others(names: list[str], *taken: str) -> list[str]:
    """The names that are none of those taken, which Spark compares without regard to case."""
    return [n for n in names if n.lower() not in taken]


def fields_of(df: DataFrame, names: list[str]) -> str:
    """The DDL of columns of df."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def flat(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values as one buffer, and len + 1 offsets; null is the empty value."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


#: A random value for each byte.
BYTE = _splitmix(256, 11) | np.uint64(1)
#: What keeps the first bytes of a group of eight, by their number.
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with inside[byte], none of which leaves its
    document; and the number of words before each document (len + 1 values)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    w = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = w[1:] != w[:-1]
    edge[0] = edge[-1] = True
    edge[at] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = w[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, at)


def _eights(data: np.ndarray) -> np.ndarray:
    """At each place of data, the eight bytes from there on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def _later_groups(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The groups of eight bytes after each word's first, in slices of about SLICE bytes: (words, where
    each one's groups begin in the slice, the word of each group, the group's place in its word). A
    word longer than a slice is met again in the next ones."""
    long = np.flatnonzero(size > 8)
    groups = (size[long] + 7) // 8 - 1
    done, limit, first = np.cumsum(groups), SLICE >> 3, 0
    while first < len(long):
        before = int(done[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(done, before + limit, side="right")))
        n = groups[first:last]
        if n[0] > limit:
            for a in range(0, int(n[0]), limit):
                part = np.arange(a, min(a + limit, int(n[0])))
                yield long[first:last], np.zeros(1, np.int64), np.repeat(long[first], len(part)), part + 1
        else:
            begin = np.cumsum(n) - n
            yield long[first:last], begin, np.repeat(long[first:last], n), np.arange(int(n.sum())) - np.repeat(begin, n) + 1
        first = last


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: the sum of its groups of eight bytes, each spread together
    with its place, however far, spread with the length. Different words may share it by chance: where
    that would change a result, compare them with ``same_bytes``."""
    size, at = ends - starts, _eights(data)
    with np.errstate(over="ignore"):
        place = lambda k: mix((k.astype(np.uint64) + np.uint64(1)) * _GOLDEN + np.uint64(seed))
        out = mix((at[starts] & _FIRST_BYTES[np.minimum(size, 8)]) ^ place(np.zeros(1)))
        for words, begin, word, k in _later_groups(size):
            value = mix((at[starts[word] + 8 * k] & _FIRST_BYTES[np.minimum(size[word] - 8 * k, 8)]) ^ place(k))
            out[words] += np.add.reduceat(value, begin)
        return mix(out + size.astype(np.uint64) * _GOLDEN)


def same_bytes(data: np.ndarray, starts: np.ndarray, size: np.ndarray, others: np.ndarray, other_starts: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether each word of data and its partner in others have the same bytes."""
    own, theirs = _eights(data), _eights(others)
    keep = _FIRST_BYTES[np.minimum(size, 8)]
    same = (size == other_size) & ((own[starts] & keep) == (theirs[other_starts] & keep))
    for words, begin, word, k in _later_groups(np.where(same, size, 0)):
        keep = _FIRST_BYTES[np.minimum(size[word] - 8 * k, 8)]
        same[words] &= np.logical_and.reduceat((own[starts[word] + 8 * k] & keep) == (theirs[other_starts[word] + 8 * k] & keep), begin)
    return same
