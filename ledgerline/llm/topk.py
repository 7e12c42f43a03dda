"""Exact top-k inner products by sorted-list aggregation without random access (operator 10).

Each block of vectors keeps, per dimension, its rows sorted by component. A query reads the
lists of its nonzero components from the end that pays most, all to the same depth, round after
round. Rows read so far have a lower bound (the sum of what was read, unread parts at their
least possible) and an upper bound (unread parts at the lists' current values). Reading stops
once no row outside the k best lower bounds can reach them, or once a round rules out less than half
of the rows that were left, as the next would cost more than their scores; what may still qualify
gets its final score. The k best rows of earlier blocks of a task already bound the next block.

Scale: rows are read once per block of queries; a block of at most ``QUERY_BYTES`` is broadcast, and
each task returns k rows per query, merged by one aggregation. With more than one block a block's best
rows are written before the next is read, so the driver and the executors hold one block at a time. The
work is queries x rows by the query's meaning; nothing is joined or emitted per pair.

Defined cases: where a sum of products may reach 2**53, the block is scored in whole numbers, without
bounds; one that may reach 2**63 is no long and raises; equal scores go to the smaller vec_id; very
long vectors are compared whole; vectors that are null or hold null or non-finite components take no
part; vectors of different lengths are compared over the components that both have; rows that share the
query's vec_id are its own and no candidates; rows with a null vec_id are no queries, and no
candidates as ties need an id; repeated candidate rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, lean, table, tune

TOP, EVERY, SCALE = 10, 100, 1024
#: Bytes of queries broadcast at once; rows of a block of sorted lists; queries handled at once on it.
QUERY_BYTES, BLOCK_ROWS, QUERY_GROUP = 16 << 20, 4096, 128
#: Sums that doubles hold exactly, and that longs hold.
EXACT, LARGEST = float(1 << 53), float((1 << 63) - (1 << 54))
#: Depths of the reading rounds as shares of a list.
ROUNDS = (0.125, 0.25, 0.5, 0.75)


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * component) of every usable vector."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    # A comparison with null is null, so forall is true for finite components only.
    usable = F.col(vector_col).isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    # From 2**52 on a double is a whole number, and may be none of the longs that floor() returns.
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < float(1 << 52), F.floor(c * scale).cast("double")).otherwise(c * scale))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, whole).alias("v")).where("v is not null and vec_id is not null")


class Lists:
    """The sorted lists of one block of vectors (n x d, whole numbers as doubles)."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        order = np.argsort(-x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(n)[:, None], axis=0)

    def bounds(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of every query and row after reading each list to ``depth``."""
        n = len(self.x)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        seen_up, seen_down = (self.rank < depth).astype(float), (self.rank >= n - depth).astype(float)
        read = up @ (self.x * seen_up).T + down @ (self.x * seen_down).T
        # Of an unread part: at most the list's current value, at least the other end's.
        next_up, next_down = self.sorted[min(depth, n - 1)], self.sorted[max(n - 1 - depth, 0)]
        most_up, most_down = up * next_up, down * next_down
        least_up, least_down = up * self.sorted[n - 1], down * self.sorted[0]
        unread = lambda a, b: (a.sum(axis=1) + b.sum(axis=1))[:, None] - a @ seen_up.T - b @ seen_down.T
        return read + unread(least_up, least_down), read + unread(most_up, most_down)


def _best(lists: Lists, ids: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
    """For each query the rows of the block that may be among its k best, floor known."""
    n = len(ids)
    mine = own[:, None] == ids[None, :]
    live = ~mine
    for share in ROUNDS:
        if n <= 4 * k:
            break
        depth = int(n * share)
        lower, upper = lists.bounds(q, depth)
        lower = np.where(mine, -np.inf, lower)
        kth = np.maximum(np.partition(lower, n - k, axis=1)[:, n - k], floor) if n > k else floor
        before, live = live.sum(), (upper >= kth[:, None]) & ~mine
        if live.sum() <= 4 * k * len(q) or live.sum() > before // 2:
            break
    return [(i, np.flatnonzero(live[i])) for i in range(len(q))]


def _scored(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of rows and queries (queries x rows) as whole numbers of 64 bits."""
    return np.stack([(x.astype(np.int64) * one.astype(np.int64)).sum(axis=1) for one in q])


def _merge(best: list, i: int, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    s, v = np.concatenate([best[i][0], scores]), np.concatenate([best[i][1], ids])
    keep = np.lexsort((v, -s))[:k]
    best[i] = (s[keep], v[keep])


def top_k(rows: DataFrame, queries: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, v) rows for (vec_id, v) queries."""
    spark = rows.sparkSession
    tune(spark, 4096)
    n, widest = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_blocks = max(1, -(-n * 8 * (widest + 1) // query_bytes))
    parts = []
    for b in range(n_blocks):
        block = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)) == b)
        got = block.select("vec_id", "v").toArrow().sort_by("vec_id").combine_chunks()
        ids, values = got["vec_id"].to_numpy(), got["v"].combine_chunks()
        size = np.diff(values.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
        q = np.zeros((len(ids), max(1, int(size.max(initial=0)))))
        q[np.repeat(np.arange(len(ids)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = values.flatten().to_numpy(zero_copy_only=False) if len(ids) else 0.0
        sent = spark.sparkContext.broadcast((ids, q))
        schema = pa.schema([("query_no", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch], sent=sent, schema=schema) -> Iterator[pa.RecordBatch]:
            own, q = sent.value
            if not len(own):
                return
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]
            for ids, x in _blocks(batches, q.shape[1]):
                most = float((np.abs(q) @ np.abs(x).max(axis=0, initial=0)).max())
                if most >= EXACT:
                    if most >= LARGEST:
                        raise ValueError("a score that may reach 2**63 is no long")
                    for i, scores in enumerate(_scored(x, q)):
                        _merge(best, i, scores[ids != own[i]], ids[ids != own[i]], k)
                    continue
                lists = Lists(x)
                for a in range(0, len(own), QUERY_GROUP):
                    part = slice(a, a + QUERY_GROUP)
                    floor = np.array([s[-1] if len(s) == k else -np.inf for s, _ in best[part]])
                    for i, live in _best(lists, ids, q[part], own[part], floor, k):
                        if len(live):
                            _merge(best, a + i, (x[live] @ q[a + i]).astype(np.int64), ids[live], k)
            n = [len(s) for s, _ in best]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own)), n), pa.int32()), pa.array(np.repeat(own, n)), pa.array(np.concatenate([v for _, v in best])), pa.array(np.concatenate([s for s, _ in best]))], schema=schema)

        part = rows.mapInArrow(lean(run), "query_no int, query_id long, vec_id long, score long").withColumn("block", F.lit(b))
        if n_blocks > 1:
            part = cut(spark, part)
            sent.destroy()
        parts.append(part)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("block", "query_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        values = b.column(1)
        for s in range(0, b.num_rows, BLOCK_ROWS):
            part = values.slice(s, BLOCK_ROWS)
            n = np.diff(part.offsets.to_numpy())
            flat_ = part.flatten().to_numpy(zero_copy_only=False)
            x = np.zeros((len(part), width))
            row = np.repeat(np.arange(len(part)), n)
            at = np.arange(len(flat_)) - np.repeat(np.cumsum(n) - n, n)
            keep = at < width
            x[row[keep], at[keep]] = flat_[keep]
            yield b.column(0).slice(s, BLOCK_ROWS).to_numpy(), x


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


SQL = """
with e as (select vec_id, list_transform(embedding, lambda c: floor(1024 * cast(c as double))) as v from embeddings
           where embedding is not null and vec_id is not null and list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false)))),
p as (select q.vec_id as query_id, e.vec_id, cast(list_dot_product(q.v, e.v) as bigint) as score from e, e q where q.vec_id % 100 = 0 and e.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""
