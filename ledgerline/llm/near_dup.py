"""Near-duplicate documents by a chosen-path set similarity join (operator 6).

A document is the set of its distinct 5-word shingles. Trees branch documents: at a node a set
follows ``BRANCHES`` chosen coordinates, each to the child that its own minwise token names, so
two sets of similarity s part on one branch with probability 1 - s only. A node of at most
``SLAB`` sets is compared exhaustively on ``COORDINATES`` further minwise tokens; likely pairs are
confirmed on the full sets, and confirmed links make the components. Larger nodes branch on.

The roots' branches are named by 64-bit minwise values (few unrelated sets meet, however many
documents there are), those below by coordinates that a hash of the node draws. A pair at the
least similarity, 0.75, is in no common node with probability 0.25**12 = 6e-8 where nodes end at
the first level, and less than 5e-7 where they branch ``LEVELS`` times; it goes unconfirmed with
2e-5, as its estimate is below ``LIKELY`` (both computed). More similar pairs are missed far less.

Scale and skew:

* Documents with equal sets are one row from the start (a partial aggregation), so exact copies
  cost nothing more.
* Ids alone (24 bytes) are counted by node. Only rows of nodes that hold two components or more
  take their tokens along; most sets meet nobody and end here.
* The nodes (fewer than ``HOT_NODES``) that hold more than a ``HOT_NODES``-th of a level's rows are
  broadcast to their rows, so no large node is one task of a join by node.
* A node larger than ``SLAB`` is dealt over slabs, which are groups of their own; ``PIVOTS`` of its
  rows stand in each slab. Then its rows branch on; after ``LEVELS`` levels they are closed.
* From a group go at most as many pairs as it has rows: all likely ones if they are so few, else
  a spanning forest of the likeliest. Groups with more likely pairs are closed: the rows of such
  pairs take their full sets along, in blocks of bounded bytes and rows, each pair of blocks is
  tested by itself, and only links that join components leave it. So no link is lost and the pairs
  of a group are never written.

Defined cases: a document without words or text has an empty set and links with nothing; a null
id has no component (null) and stays kept; rows that repeat a doc_id count as one document;
equal sets link at similarity 1; equal estimates are taken in the order of set ids, which changes
no component; a very long text is read whole, and its set is as long as it needs to be; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, _splitmix, clean_text, cut, flat, lean, mix, table, tune, word_hashes, words_of
from ledgerline.llm.components import components
from ledgerline.llm.tokens import CHUNK

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
COORDINATES, TREES, BRANCHES, LEVELS = 96, 4, 3, 3
#: A pair whose estimate is below goes unconfirmed: at the threshold 2 in 10**5 pairs have fewer
#: than 54 of 96 equal tokens.
LIKELY = 54
#: Rows up to which a node is compared exhaustively; rows of a larger node that every slab sees.
SLAB, PIVOTS = 4096, 4
#: Nodes with more than a HOT_NODES-th of a level's rows are broadcast: there are fewer of them.
HOT_NODES = 10_000
#: Full sets of one block of a node that is closed.
BLOCK_BYTES = 8 << 20
#: Endpoints up to which their ids (8 bytes each) are broadcast to the scan of the texts.
BROADCAST_IDS = 500_000

_XOR = (_splitmix(COORDINATES, 5) >> np.uint64(32)).astype(np.uint32)
_MUL = (_splitmix(COORDINATES, 6) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_PLACE = _splitmix(WORDS, 7) | np.uint64(1)
_ROOT_XOR, _ROOT_MUL = _splitmix(TREES * BRANCHES, 8), _splitmix(TREES * BRANCHES, 9) | np.uint64(1)
#: The set ids that are least after these are xored in are a large node's pivots.
_PIVOT = (0, -1, 0x35A7C94E1B0D6F82, 0x6C3B9A5D71E8042F)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, and len + 1 offsets."""
    data, at = flat(texts)
    data = LOWER[data]
    starts, ends, first = words_of(data, at, CHUNK)
    words, n = word_hashes(data, starts, ends), np.diff(first)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words), np.uint64)
        for j in range(WORDS):
            total[: max(0, len(words) - j)] += words[j:] * _PLACE[j]
        total = mix(total)
        counts = np.maximum(n - WORDS + 1, 0)
        short = np.flatnonzero((n > 0) & (n < WORDS))
        keep = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        out, sizes = total[keep], counts.copy()
        if len(short):
            own = [mix(np.array([np.sum(words[first[d] : first[d + 1]] * _PLACE[: n[d]]) + np.uint64(int(n[d]))], np.uint64))[0] for d in short.tolist()]
            where = np.cumsum(counts)[short] - counts[short]
            out = np.insert(out, where, own)
            sizes[short] = 1
    bound = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bound[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[bound]


def minwise(sets: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """COORDINATES 16-bit minwise tokens of each nonempty set; zeros for an empty one."""
    n = len(bound) - 1
    out = np.zeros((n, COORDINATES), np.uint16)
    full = np.flatnonzero(np.diff(bound) > 0)
    if len(full):
        x, at = (sets >> np.uint64(32)).astype(np.uint32), bound[full]
        with np.errstate(over="ignore"):
            for j in range(COORDINATES):
                least = np.minimum.reduceat((x ^ _XOR[j]) * _MUL[j], at)
                out[full, j] = ((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    return out


def root_keys(sets: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The 64-bit minwise values of each nonempty set that name its children of the roots."""
    out = np.zeros((len(bound) - 1, TREES * BRANCHES), np.uint64)
    full = np.flatnonzero(np.diff(bound) > 0)
    if len(full):
        with np.errstate(over="ignore"):
            for j in range(TREES * BRANCHES):
                out[full, j] = np.minimum.reduceat((sets ^ _ROOT_XOR[j]) * _ROOT_MUL[j], bound[full])
    return out.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), values.ravel())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (a 64-bit hash of the set), keys (of the roots' children) and sig
    (the minwise tokens) of each row of (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, bound = shingles(batch.column(1))
            sig = pa.array([s.tobytes() for s in minwise(sets, bound)], pa.binary())
            columns = [batch.column(0), pa.array(np.diff(bound)), pa.array(_set_ids(sets, bound)), _lists(root_keys(sets, bound)), sig]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, set_id long, keys array<long>, sig binary")


def _set_ids(sets: np.ndarray, bound: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(0x5851F42D4C957F2D)))])
        return mix(total[bound[1:]] - total[bound[:-1]]).view(np.int64)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(flat(column)[0], np.uint16).reshape(len(column), COORDINATES)


# ---- nodes


def _roots(nodes: DataFrame) -> DataFrame:
    """(node, a): the children of the roots that each set goes to."""
    each = nodes.select(F.posexplode("keys").alias("place", "key"), F.col("set_id").alias("a"))
    return each.select(F.xxhash64("place", "key").alias("node"), "a")


def _children(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, a): the children that the rows (node, a) go to."""
    schema = pa.schema([("node", pa.int64()), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sig = batch.column("node").to_numpy().view(np.uint64), _tokens(batch.column("sig"))
            drawn = (mix(node ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(COORDINATES)).astype(np.int64)
            for j in range(BRANCHES):
                at = (drawn + j * (COORDINATES // BRANCHES)) % COORDINATES
                token = sig[np.arange(len(at)), at].astype(np.uint64)
                child = mix(node ^ mix((at.astype(np.uint64) << np.uint64(16)) + token + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("a")], schema=schema)

    tokens = nodes.select(F.col("set_id").alias("a"), "sig")
    return rows.select("node", "a").join(tokens, "a").select("node", "a", "sig").mapInArrow(lean(run), "node long, a long")


def _mixed(rows: DataFrame) -> DataFrame:
    """(node, n and p0..): of each node of rows (node, a, comp) with more than one component, its
    number of rows and its pivots."""
    pivots = [F.min(F.col("a").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)).alias(f"p{k}") for k, x in enumerate(_PIVOT[:PIVOTS])]
    counted = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), *pivots)
    return counted.where("low <> high").drop("low", "high")


def _hot(nodes: DataFrame) -> tuple[int | None, int]:
    """Of nodes (node, n, ..) of n rows each: the n above which they are hot, a ``HOT_NODES``-th of all rows
    and ``SLAB`` at least, so that fewer than ``HOT_NODES`` are; None if none is. And how many are above ``SLAB``."""
    most, rows, n_large = nodes.agg(F.max("n"), F.sum("n"), F.count_if(F.col("n") > SLAB)).first()
    least = max(SLAB, (rows or 0) // HOT_NODES)
    return (least if (most or 0) > least else None), n_large


def _at_nodes(rows: DataFrame, nodes: DataFrame, hot: int | None, value: str = "n") -> DataFrame:
    """rows (node, a, ..) of the nodes (node, n, ..) with the nodes' value, in one pass over the rows. Those of
    hot nodes get it by broadcast and are dealt by a; the others meet by key, and no key has many."""
    if hot is None:
        return rows.join(nodes.select("node", value), "node")
    known = nodes.where(F.col("n") > hot).select("node", F.col(value).alias("hot"))
    others = nodes.where(F.col("n") <= hot).select(F.col("node").alias("key"), F.col(value).alias("cold"))
    key = F.when(F.col("hot").isNull(), F.col("node")).otherwise(F.xxhash64("a"))
    met = rows.join(F.broadcast(known), "node", "left").withColumn("key", key).join(others, "key", "left")
    return met.withColumn(value, F.coalesce("hot", "cold")).where(F.col(value).isNotNull()).drop("hot", "cold", "key")


def _groups(rows: DataFrame, mixed: DataFrame, hot: int | None) -> DataFrame:
    """(node, slab, a): the rows of mixed nodes, those of a large node dealt over slabs, with the
    node's pivots in each."""
    slabs = F.ceil(F.col("n") / SLAB).cast("int")
    slab = F.pmod(F.xxhash64("a"), slabs).cast("int")
    own = _at_nodes(rows, mixed, hot).select("node", slab.alias("slab"), "a")
    large = mixed.where(F.col("n") > SLAB).select("node", "n", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("a"))
    seen = large.select("node", F.explode(F.sequence(F.lit(0), slabs - 1)).alias("slab"), "a", slab.alias("home"))
    return own.union(seen.where("slab <> home").select("node", "slab", "a"))


# ---- comparing a group


def estimates(sig: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """How many tokens two rows share, where they are likely and apart (a mask) allows; else 0."""
    n = len(sig)
    out, step = np.zeros((n, n), np.uint8), max(1, (1 << 22) // (n * COORDINATES))
    for i in range(0, n, step):
        out[i : i + step] = np.count_nonzero(sig[i : i + step, None] == sig[None], axis=2)
    out[(out < LIKELY) | ~apart] = 0
    return out


def forest(weight: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the greatest weights over the rows' components."""
    n, out = len(comp), []
    best, source, waiting = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for _ in range(n):
        v = int(np.argmax(np.where(waiting, best, -1)))
        if 0 < best[v] < 255:
            out.append((int(source[v]), v))
        waiting[v] = False
        near = np.where(comp == comp[v], 255, weight[v])
        closer = near > best
        best[closer], source[closer] = near[closer], v
    return out


def _group_pairs(sig: np.ndarray, comp: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Likely pairs between different components, at most as many as there are rows; and if some
    were left out, the rows of likely pairs."""
    weight = estimates(sig, comp[:, None] != comp[None])
    n_likely = np.count_nonzero(weight) // 2
    if n_likely <= len(comp):
        i, j = np.nonzero(np.triu(weight))
        return list(zip(i.tolist(), j.tolist())), np.zeros(0, np.int64)
    return forest(weight, comp), np.flatnonzero(weight.any(axis=1))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The batches cut so that no run of rows with equal first ``keys`` columns is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        new = bool(held) and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in enumerate(columns))
        if held and (new or len(edges)):
            first = 0 if new else int(edges[0])
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held, batch = [], batch.slice(first)
            edges = edges - first
            edges = edges[edges > 0]
        if len(edges):
            yield pa.Table.from_batches([batch.slice(0, int(edges[-1]))])
            batch = batch.slice(int(edges[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _edges(columns: list[np.ndarray]) -> list[int]:
    changed = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(np.concatenate([[True], changed, [True]])).tolist()


def _compare(groups: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, node) of groups (node, slab, a): likely pairs a < b, with a null node; and with a null
    b the rows of likely pairs of nodes that gave only some of them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 2):
            node, slab, a, comp = (t.column(c).to_numpy() for c in ("node", "slab", "a", "comp"))
            sig = _tokens(t.column("sig").combine_chunks())
            bounds = _edges([node, slab])
            sizes = np.diff(bounds)
            two = np.array(bounds[:-1], np.int64)[sizes == 2]
            two = two[(np.count_nonzero(sig[two] == sig[two + 1], axis=1) >= LIKELY) & (comp[two] != comp[two + 1])]
            pairs, again = [(two, two + 1)], []
            for g in np.flatnonzero(sizes > 2).tolist():
                s, e = bounds[g], bounds[g + 1]
                found, rows = _group_pairs(sig[s:e], comp[s:e])
                if found:
                    pairs.append(tuple(np.array(x, np.int64) + s for x in zip(*found)))
                again.append(rows + s)
            x, y = (a[np.concatenate(p)] for p in zip(*pairs))
            more = np.concatenate([np.zeros(0, np.int64), *again])
            none_x, none_y = np.zeros(len(x), bool), np.ones(len(more), bool)
            columns = [
                pa.array(np.concatenate([np.minimum(x, y), a[more]])),
                pa.array(np.concatenate([np.maximum(x, y), a[more]]), mask=np.concatenate([none_x, none_y])),
                pa.array(np.concatenate([x, node[more]]), mask=np.concatenate([~none_x, ~none_y])),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    known = sets.select("set_id", "comp").join(nodes.select("set_id", "sig"), "set_id").withColumnRenamed("set_id", "a")
    whole = groups.join(known, "a").select("node", "slab", "a", "comp", "sig")
    return whole.repartition("node", "slab").sortWithinPartitions("node", "slab", "a").mapInArrow(lean(run), "a long, b long, node long")


# ---- confirming on the full sets


def _joins(comp: np.ndarray, part: np.ndarray, sig: np.ndarray, items: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of components that a pair of rows links, tested on the full sets; enough of them to
    join all that are linked. Rows of two parts are compared across the parts only."""
    apart = comp[:, None] != comp[None]
    if part.min() != part.max():
        apart &= part[:, None] != part[None]
    likely = estimates(sig, apart) > 0
    size = np.array([len(x) for x in items])
    values, number = np.unique(np.concatenate(items), return_inverse=True)
    begin, label, out = np.cumsum(size) - size, comp.copy(), []
    mark = np.zeros(len(values), bool)
    for i in range(len(comp) - 1):
        other = np.flatnonzero(likely[i, i + 1 :] & (label[i + 1 :] != label[i])) + i + 1
        if not len(other):
            continue
        own, n = number[begin[i] : begin[i] + size[i]], size[other]
        mark[own] = True
        shared = np.array([np.count_nonzero(mark[number[begin[j] : begin[j] + size[j]]]) for j in other.tolist()])
        mark[own] = False
        for j in other[DENOMINATOR * shared >= NUMERATOR * (size[i] + n - shared)].tolist():
            if label[j] != label[i]:
                out.append((int(comp[i]), int(comp[j])))
                label[label == label[j]] = label[i]
    return out


def _close(docs: DataFrame, rows: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Links (u, v) between the components of each node of rows (node, a), None if all nodes lie in one
    component. Each row takes its full set along, to each pair of blocks of its node that its own
    block is in."""
    spark = docs.sparkSession
    named = rows.distinct().join(sets.select(F.col("set_id").alias("a"), "comp", "rep", "n_shingles"), "a")
    counted = named.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("items"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    blocks = F.ceil(F.greatest(F.col("items") * 8 / BLOCK_BYTES, F.col("n") / SLAB)).cast("int")
    mine = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    counted = cut(spark, counted.select("node", "n", blocks.alias("blocks")))
    met = _at_nodes(named, counted, _hot(counted)[0], "blocks")
    open_ = cut(spark, met.select("node", "a", "comp", "rep", "blocks", mine.alias("part")))
    ends = open_.select(F.col("a").alias("set_id"), "rep").distinct()
    if not (n_ends := ends.count()):
        return None
    full = _sets(docs, ends, n_ends).join(nodes.select("set_id", "sig"), "set_id").withColumnRenamed("set_id", "a")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = open_.select("node", "a", "comp", "part", other)
    met = met.select("node", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "a", "comp", "part")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            comp, part = t.column("comp").to_numpy(), t.column("part").to_numpy()
            sig, values = _tokens(t.column("sig").combine_chunks()), t.column("items").combine_chunks()
            at, items = values.offsets.to_numpy(), values.values.to_numpy()
            bounds, found = _edges([t.column(c).to_numpy() for c in ("node", "low", "high")]), []
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s > 1:
                    found += _joins(comp[s:e], part[s:e], sig[s:e], [items[at[k] : at[k + 1]] for k in range(s, e)])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    whole = met.join(full, "a").select("node", "low", "high", "a", "comp", "part", "sig", "items")
    spread = whole.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high", "a")
    return spread.mapInArrow(lean(run), "u long, v long").distinct()


def _sets(docs: DataFrame, ends: DataFrame, n_ends: int) -> DataFrame:
    """(set_id, items): the full shingle sets of the endpoints (set_id, rep), at most n_ends."""
    schema = pa.schema([("set_id", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, bound = shingles(batch.column(0))
            wanted = batch.column(1).to_numpy()
            keep = np.flatnonzero(_set_ids(sets, bound) == wanted)
            items = [sets[bound[i] : bound[i + 1]].view(np.int64) for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(wanted[keep]), pa.array(items, pa.list_(pa.int64()))], schema=schema)

    ids = ends.select(F.col("rep").alias("doc_id"), F.col("set_id").alias("wanted"))
    texts = docs.join(F.broadcast(ids) if n_ends <= BROADCAST_IDS else ids, "doc_id").select("text", "wanted")
    return texts.mapInArrow(lean(run), "set_id long, items array<long>").groupBy("set_id").agg(F.first("items").alias("items"))


def confirmed(docs: DataFrame, pairs: DataFrame, n_pairs: int, sets: DataFrame) -> DataFrame:
    """Links (u, v) between documents of the pairs (a, b) of set ids that reach the threshold on
    their full sets."""
    rep = sets.select("set_id", "rep")
    ends = pairs.select(F.col("a").alias("set_id")).union(pairs.select(F.col("b").alias("set_id"))).distinct()
    full = _sets(docs, ends.join(rep, "set_id"), 2 * n_pairs).join(rep, "set_id")
    left = pairs.join(full.select(F.col("set_id").alias("a"), F.col("items").alias("x"), F.col("rep").alias("u")), "a")
    both = left.join(full.select(F.col("set_id").alias("b"), F.col("items").alias("y"), F.col("rep").alias("v")), "b")
    counted = both.select("u", "v", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return counted.where(DENOMINATOR * F.col("i") >= NUMERATOR * (F.col("n") - F.col("i"))).select("u", "v")


# ---- the join


class _Join:
    """The sets, and what is known of their components so far."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes, self.spark = docs, nodes, docs.sparkSession
        self.labels, self.links = None, []

    def add(self, links: DataFrame) -> None:
        self.links.append(cut(self.spark, links.where("u <> v")))

    def sets(self, rows: DataFrame | None = None) -> DataFrame:
        """(set_id, rep, n_shingles, comp) of all sets, or of those in rows (.., a): comp is the least known
        document of the set's component. After the first level only the rows that go on are labelled anew."""
        if self.links:
            # The components so far stand for their links.
            before = [] if self.labels is None else [self.labels.where("node <> component").select("node", "component")]
            self.labels = components(reduce(DataFrame.union, self.links + before))
            self.links = []
        bare = self.nodes.select("set_id", "rep", "n_shingles")
        if self.labels is None:
            return bare.withColumn("comp", F.col("rep"))
        if rows is not None:
            bare = rows.select(F.col("a").alias("set_id")).distinct().join(bare, "set_id")
        bare = bare.join(self.labels.withColumnRenamed("node", "rep"), "rep", "left")
        return cut(self.spark, bare.select("set_id", "rep", "n_shingles", F.coalesce("component", "rep").alias("comp")))

    def look(self, rows: DataFrame, sets: DataFrame, last: bool) -> DataFrame | None:
        """Compare the nodes of rows (node, a), whose sets are known; the rows of large nodes, None if there are none."""
        mixed = cut(self.spark, _mixed(rows.join(sets.select(F.col("set_id").alias("a"), "comp"), "a")))
        hot, n_large = _hot(mixed)
        found = cut(self.spark, _compare(_groups(rows, mixed, hot), sets, self.nodes))
        n_pairs, n_rows = found.agg(F.count("b"), F.count_if(F.col("b").isNull())).first()
        if n_pairs:
            self.add(confirmed(self.docs, found.where("b is not null").select("a", "b").distinct(), n_pairs, sets))
        again = found.where("b is null").select("node", "a") if n_rows else None
        rest = None
        if n_large:
            large = mixed.where(F.col("n") > SLAB).select("node", "n")
            again = again if again is None else again.join(large.select("node"), "node", "left_anti")
            rest = cut(self.spark, _at_nodes(rows, large, hot).select("node", "a"))
            if last:
                again, rest = rest if again is None else again.union(rest), None
        if again is not None:
            links = _close(self.docs, again, self.sets(again) if self.links else sets, self.nodes)
            if links is not None:
                self.add(links)
        return rest


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    spark = docs.sparkSession
    tune(spark)
    docs = clean_text(docs, id_col, text_col)
    signed = cut(spark, signatures(docs))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = usable.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    nodes = cut(spark, nodes)
    join = _Join(docs, nodes)
    # Rows that repeat a doc_id with several sets are one document: their nodes are linked.
    several = usable.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high").select("doc_id")
    if several.count():
        join.add(usable.join(several, "doc_id").join(nodes.select("set_id", "rep"), "set_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    rows, sets = _roots(nodes), join.sets()
    for level in range(LEVELS):
        rest = join.look(rows, sets, last=level == LEVELS - 1)
        if rest is None:
            break
        rows, sets = cut(spark, _children(rest, nodes)), join.sets(rest)
    named = join.sets().select("set_id", F.col("comp").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id")).join(named, "set_id", "left")
    own = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: A direct form, for small tables: all shingles, their pairs, and closure by recursion.
SQL = """
with recursive d as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct k, doc_id, hash(unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] end)) as g from d),
n as (select k, doc_id, count(*) as n from s group by all),
c as (select a.k as a, b.k as b, count(*) as i from s a join s b on a.g = b.g and a.k < b.k group by all),
l as (select x.doc_id as u, y.doc_id as v from c join n x on x.k = a join n y on y.k = b where 100 * i >= 75 * (x.n + y.n - i)),
e as (select u, v from l union select v, u from l),
r as (select u as node, u as root from e union select e.v, r.root from r join e on e.u = r.node where r.root < e.v),
m as (select node, min(root) as root from r group by node)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(coalesce(m.root, d.doc_id), d.doc_id) as component_id,
       d.doc_id = least(coalesce(m.root, d.doc_id), d.doc_id) as kept
from d left join n using (k) left join m on m.node = d.doc_id
"""
