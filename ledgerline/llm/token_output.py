"""Packed token ids as binary rows (operator 5).

Each row is one training sequence: its padded ids as little-endian unsigned 32-bit bytes, the
cumulative lengths of its segments (0 first), and the positions, which start again at 0 with
every segment. Packing is best-fit decreasing with a segment tree of remaining capacities;
overlong documents are first cut into full windows, so nothing is lost and every id stands in
exactly one row.

Scale: documents are dealt by a hash of their row's place into blocks of about ``block_docs``
documents or ``block_bytes`` of text, whichever is less; token ids are made inside the block, so texts,
not ids, are shuffled, once. A block is bounded whatever the documents' source or length, but for one
document that is longer.

Dealing goes by the place of a row, so what stands behind a shuffle has to be written or checkpointed
before, as in operator 2.

Defined cases: very long texts are cut into as many full windows as they need; equal lengths keep the
order of doc_id and place; a null text is empty (its ids are the end id alone); repeated rows are packed
each; padding holds ``pad_id`` with position 0; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import clean_text, table, tune
from ledgerline.llm.packing import END_ID, WINDOW, best_fit_decreasing, cut_lengths, measured
from ledgerline.llm.tokens import tokens

OUT = "sequence_id long, n_ids long, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"


#: Text of one block, about.
BLOCK_BYTES = 16 << 20


def sequences(docs: DataFrame, window: int = WINDOW, block_docs: int = 2000, block_bytes: int = BLOCK_BYTES, path: str | None = None, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    n_docs, n_bytes = measured(docs)
    n_blocks = max(1, -(-n_docs // block_docs), -(-n_bytes // block_bytes))
    schema = pa.schema([("sequence_id", pa.int64()), ("n_ids", pa.int64()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("place", "ascending")])
        ids, at = tokens(path).encode(t["text"].combine_chunks(), end_id)
        cuts = [(i, s, k) for i, n in enumerate(np.diff(at).tolist()) for s, k in cut_lengths(n, window)]
        where, offset, n = best_fit_decreasing(np.array([k for *_, k in cuts], np.int64), window)
        docs_, rows = t["doc_id"].to_pylist(), [[] for _ in range(n)]
        for p in np.lexsort((offset, where)).tolist():
            rows[where[p]].append(cuts[p])
        base, out = t["block"][0].as_py() << 24, []
        for w, segments in enumerate(rows):
            used = sum(k for *_, k in segments)
            width = used if used & (used - 1) == 0 else window
            row, places = np.full(width, pad_id, "<u4"), np.zeros(width, "<u4")
            row[:used] = np.concatenate([ids[at[i] + s : at[i] + s + k] for i, s, k in segments])
            places[:used] = np.concatenate([np.arange(k, dtype=np.uint32) for *_, k in segments])
            ends = np.cumsum([0, *(k for *_, k in segments)]).tolist()
            out.append((base + w, used, row.tobytes(), ends, places.tobytes(), [docs_[i] for i, *_ in segments], [s for _, s, _ in segments]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    placed = clean_text(docs).withColumn("place", F.monotonically_increasing_id())
    # The low bits of the place count rows, the high ones tasks: both take part in the dealing.
    block_of = F.pmod(F.col("place") + F.shiftright("place", 33) * 7919, F.lit(n_blocks)).cast("long")
    return placed.withColumn("block", block_of).groupBy("block").applyInArrow(block, OUT)


def digest(packed: DataFrame) -> DataFrame:
    """The rows with checksums in place of the id and position bytes, for comparing."""
    return packed.select("sequence_id", "n_ids", (F.octet_length("input_ids") / 4).cast("long").alias("width"), F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"), F.size("doc_ids").cast("long").alias("n_segments"), "cu_seqlens", "doc_ids", "starts")


def write(packed: DataFrame, where: str) -> None:
    """Write the sequences as Parquet: binary id matrices with their segment lengths."""
    packed.write.mode("overwrite").parquet(where)


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "documents"))
