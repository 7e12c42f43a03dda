"""Best-fit-decreasing packing of token sequences (operator 2) and the tokens behind it.

Documents become token ids, ids of overlong documents are cut into full windows, and the
rests are packed: longest first, each into the open window with the least room that still
holds it. The open windows stand in a segment tree indexed by remaining capacity.

Scale: tokenising is one map over the scan. Only (document, start, length, checksum) of the
pieces is shuffled, dealt round robin into blocks of about ``block_pieces`` documents, so a
block is bounded however the documents' lengths, sources or copies are spread; each block is
packed alone and wastes less than one window. The ids themselves never move.

Dealing goes by the place of a row: an input whose rows could come in another order when a lost part
of it is read again (what stands behind a shuffle) has to be written or checkpointed before, as the
pipeline does; files always give the same order.

Defined cases: very long texts are cut into as many full windows as they need; of equal lengths the
least doc_id, start, checksum and place go first; a null text is the empty one, whose ids are the end id alone; repeated rows and
equal or null ids are packed each as a document of its own; an empty table gives no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import clean_text, lean, tune
from ledgerline.llm.tokens import tokens

WINDOW, END_ID = 4096, 2

class OpenWindows:
    """A segment tree over remaining capacities 0..window: which have open windows."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room >= length, removed; None if there is none."""
        k, count = length + self.size, self.count
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k <<= 1
                if not count[k]:
                    k += 1
        room = k - self.size
        self._add(room, -1)
        return room, self.stacks[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of each length, and the number of windows. Lengths are 1..window; equal
    lengths keep their order."""
    where, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    open_ = OpenWindows(window)
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        size = int(lengths[i])
        if (found := open_.take(size)) is None:
            room, w, n = window, n, n + 1
        else:
            room, w = found
        where[i], offset[i] = w, window - room
        if room > size:
            open_.put(room - size, w)
    return where, offset, n


def cut_lengths(n: int, window: int) -> list[tuple[int, int]]:
    """Full windows first, then the rest."""
    return [(s, min(window, n - s)) for s in range(0, n, window)]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, block long, place long"


def measured(docs: DataFrame) -> tuple[int, int]:
    """How many documents there are, and how many bytes of text."""
    r = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    return int(r.n), int(r.bytes)


def pieces(docs: DataFrame, window: int, n_blocks: int, path: str | None, end_id: int) -> DataFrame:
    """One row per piece, dealt round robin to blocks."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        vocabulary, seen = tokens(path), 0
        for batch in batches:
            rows = []
            ids, at = vocabulary.encode(batch.column(1), end_id)
            raw, at = memoryview(ids.astype("<u4").tobytes()), at.tolist()
            for i, doc in enumerate(batch.column(0).to_pylist()):
                n, base = at[i + 1] - at[i], at[i]
                for s, k in cut_lengths(n, window):
                    rows.append((doc, s, k, zlib.crc32(raw[4 * (base + s) : 4 * (base + s + k)]), n, (seen + task * 7919) % n_blocks, (task << 36) + seen))
                    seen += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(schema), schema=schema)

    return clean_text(docs).mapInArrow(lean(run), PIECE)


def pack(docs: DataFrame, window: int = WINDOW, block_pieces: int = 8000, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded: a row per piece.

    ``padded`` is the length to which the piece's sequence is filled up: ``window``, or the
    sum of its pieces where that is a power of two.
    """
    spark = docs.sparkSession
    tune(spark)
    n_docs, n_bytes = measured(docs)
    # An id has a byte or more, so there are no more pieces than these.
    n_blocks = max(1, -(-(n_docs + n_bytes // window) // block_pieces))
    cut = pieces(docs, window, n_blocks, path, end_id)
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"
    schema = pa.schema([(c.split()[0], pa.int64()) for c in out.split(", ")])

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("place", "ascending")])
        sizes = t["length"].to_numpy()
        where, offset, n = best_fit_decreasing(sizes, window)
        used = np.bincount(where, sizes, n).astype(np.int64)
        padded = np.where((used & (used - 1)) == 0, used, window)
        ids = (np.int64(t["block"][0].as_py()) << 24) + where
        return pa.Table.from_arrays([*(t[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(ids), pa.array(offset), pa.array(padded[where])], schema=schema)

    return cut.groupBy("block").applyInArrow(block, out)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    from ledgerline.llm.common import table

    return pack(table(spark, sf_dir, "documents"))
