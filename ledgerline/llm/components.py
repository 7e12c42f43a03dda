"""Connected components of a link table, by alternating star contractions.

Every round is two aggregations and joins over the links that are left, and a contraction of what
each task holds anyway, ``CHUNK`` links at a time; links never leave the executors, and each round
is written to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut


#: Links that a task contracts at once.
CHUNK = 100_000


def _contracted(links: DataFrame) -> DataFrame:
    """Links (u, v) that join the same nodes: of each chunk, from each node to the least it reaches."""

    def stars(chunk: list[pa.RecordBatch]) -> pa.RecordBatch:
        t, top = pa.Table.from_batches(chunk), {}
        for u, v in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
            for x in (u, v):
                top.setdefault(x, x)
            while top[u] != u:
                top[u] = u = top[top[u]]
            while top[v] != v:
                top[v] = v = top[top[v]]
            if u != v:
                top[max(u, v)] = min(u, v)
        ends = []
        for x in sorted(top):  # a node's parent is less, so it already points at its root
            top[x] = top[top[x]]
            if top[x] != x:
                ends.append(x)
        return pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array([top[x] for x in ends], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield stars(held)
                held, n = [], 0
        if held:
            yield stars(held)

    return links.mapInArrow(run, "u long, v long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (u, v): the least node that it reaches."""
    spark = links.sparkSession
    ends = [F.col(c) for c in links.columns[:2]]
    e = links.select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).where("u <> v").distinct()
    e = cut(spark, _contracted(e).distinct())
    state = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == state or not now[0]:
            break
        if now[0] <= CHUNK:  # one task's chunk holds them all
            e = cut(spark, _contracted(e.coalesce(1)))
            break
        state = now
        e = cut(spark, _contracted(_small_star(_large_star(e))).distinct())
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
