"""Conversation prefix trie (operator 13).

A node is a distinct sequence of first turns; it is known by its depth and two 64-bit sums of its turns'
hashes, each mixed with its place (128 bits, from SHA-256 of role and text). All work is on rows of turns
and of nodes, never on whole conversations:

1. Turns are numbered and their sums made by running sums over rows sorted by conversation
   (``scan``), so a conversation of any length is spread over tasks.
2. Nodes are one aggregation of those rows, children another.
3. A node's rank key is made of the codes of its path's turns that follow a branching node, each behind
   a byte 0: keys of a subtree begin with its top's key, and unary chains add nothing. Depth
   orders the nodes of a chain. So keys and depths are the lexicographic rank, a preorder.
4. Every node puts an opening mark at its key and a closing mark, its key and a byte 1, at its
   subtree's end. Marks are sorted once; leaves and savings are differences of distributed prefix sums
   between a node's two marks.
5. The members that end at a node are sorted by node and id. A digest is made where a node's
   members lie in one partition; others leave as pieces of text, at most PIECE bytes each, that are
   hashed in order, one piece at a time.

Scale: rows of 60 to 100 bytes move, not texts. Turns take their node's columns from a broadcast where
the node is frequent (members above a 10,000th of all turns, of which there can be at most 10,000),
and by a join on the node otherwise, so no key of it is hot. A key has as many codes as its path has
branching nodes.

Defined cases: a null role or text is empty; rows without a conv_id name no conversation and are left out;
turns of equal number are in the order of the hash of role and text; repeated rows are turns of their
own; conversations without rebuilt turns are members of the root; negative ids take the remainder that is
not negative; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, flat, lean, mix, table, tune
from ledgerline.llm.scan import PART, ordered, part_of, running

WORD = r"[^\x20\x09-\x0D]+"
EVERY, MOST = 20, 3
FREQUENT = 10_000
#: Bytes of ids that a piece holds at most, about.
PIECE = 1 << 16
NODE = ["depth", "h1", "h2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, code, words): the turns numbered from 1, with 16 bytes of the SHA-256 of role and
    text, and the number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("code"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    sorted_ = ordered(conversations.sparkSession, rows, "conv_id", F.col("turn").asc_nulls_first(), "code")

    def emit(b: pa.RecordBatch, _, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(sums[:, 0].view(np.int64)), b.column("code"), b.column("words")], names=["conv_id", "idx", "code", "words"])

    return running(sorted_.drop("turn"), "conv_id", _each, 1, emit, "conv_id long, idx long, code binary, words long")


def _each(b: pa.RecordBatch) -> np.ndarray:
    return np.ones((b.num_rows, 1), np.uint64)


def rebuilt(numbered: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, part, idx, code, words): of each conversation first what the conversation at the
    multiple of EVERY below gives, then its own later turns."""
    given = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST + 1)).alias("h")
    donors = numbered.where((F.pmod("conv_id", F.lit(EVERY)) == 0) & (F.col("idx") <= MOST)).withColumnRenamed("conv_id", "donor")
    wants = convs.select("conv_id", given, (F.col("conv_id") - F.pmod("conv_id", F.lit(EVERY))).alias("donor"))
    taken = wants.join(donors, "donor").where("idx <= h").select("conv_id", F.lit(0).alias("part"), "idx", "code", "words")
    return taken.unionByName(numbered.where(F.col("idx") > given).withColumn("part", F.lit(1)))


def _terms(code: pa.Array, depth: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each turn, by its hash and its depth."""
    data, _ = flat(code)
    halves = data.reshape(-1, 16).view(">u8").astype(np.uint64)
    with np.errstate(over="ignore"):
        place = mix(depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.stack([mix(halves[:, 0] ^ place), mix(halves[:, 1] + place)], axis=1)


ROWS = "conv_id long, depth long, h1 long, h2 long, p1 long, p2 long, code binary, words long"
_ROWS = [p.split()[0] for p in ROWS.split(", ")]


def prefixes(spark, sequences: DataFrame) -> DataFrame:
    """ROWS of (conv_id, part, idx, code, words): each turn with its node's sums and its parent's."""
    sorted_ = ordered(spark, sequences, "conv_id", "part", "idx").select("conv_id", "code", "words", PART)

    def deep(b: pa.RecordBatch, _, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(sums[:, 0].view(np.int64))], names=[*b.schema.names, "depth"])

    numbered = running(sorted_, "conv_id", _each, 1, deep, f"conv_id long, code binary, words long, {PART} int, depth long")

    def sums(b: pa.RecordBatch) -> np.ndarray:
        return _terms(b.column("code"), b.column("depth").to_numpy())

    def emit(b: pa.RecordBatch, values: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        before = total - values
        longs = [pa.array(x[:, k].view(np.int64) if x.flags.c_contiguous and x.shape[1] == 1 else np.ascontiguousarray(x[:, k]).view(np.int64)) for x in (total, before) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("depth"), *longs, b.column("code"), b.column("words")], names=_ROWS)

    return cut(spark, running(numbered, "conv_id", sums, 2, emit, ROWS))


def nodes_of(spark, rows: DataFrame) -> DataFrame:
    """Every node but the root, with its smallest member, members and children."""
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("smallest"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = cut(spark, nodes)
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    return cut(spark, nodes.drop("p1", "p2").join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def with_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with their nodes' columns. The frequent nodes are broadcast: members add up to the rows, so
    at most FREQUENT nodes have more than a FREQUENT-th of them."""
    total = rows.count()
    often = F.col("n_convs") * FREQUENT > total
    frequent = F.broadcast(nodes.where(often))
    rest = rows.join(F.broadcast(nodes.where(often).select(*NODE)), NODE, "left_anti").join(nodes.where(~often), NODE)
    return rows.join(frequent, NODE).unionByName(rest)


RANKED = "conv_id long, depth long, h1 long, h2 long, parent_conv_id long, n_convs long, n_children long, words long, key binary"
_RANKED = pa.schema([(p.split()[0], {"long": pa.int64(), "binary": pa.binary()}[p.split()[1]]) for p in RANKED.split(", ")])


def ranked(spark, rows: DataFrame, root: tuple[int, int]) -> DataFrame:
    """RANKED, a row per node: its key and its parent's smallest member, from the row of its own
    smallest member. root: the root's smallest member and its number of children. A conversation that
    goes on over partitions takes its key along, as long as it has branching nodes."""
    sorted_ = ordered(spark, rows.select("conv_id", *NODE, "code", "words", "smallest", "n_convs", "n_children"), "conv_id", "depth")

    def walk(batches: Iterator[pa.RecordBatch], start: dict[int, tuple | None]) -> Iterator[tuple]:
        """(row, key, smallest of its parent), from what stood before a partition (conversation, key,
        whether its last node branches, that node's smallest member)."""
        conv, key, branches, smallest = None, b"", False, None
        for k, b in enumerate(b for b in batches if b.num_rows):
            if not k and (state := start.get(part_of(b))):
                conv, key, branches, smallest = state
            for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "depth", "h1", "h2", "code", "words", "smallest", "n_convs", "n_children", PART))):
                if r[0] != conv:
                    # Inside a conversation that began before, what stood there is not known yet.
                    conv, key, branches, smallest = r[0], b"", r[1] == 1 and root[1] > 1, root[0]
                if branches:
                    key += b"\0" + r[4]
                yield r, key, smallest
                branches, smallest = r[8] > 1, r[6]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for r, key, _ in walk(batches, {}):
            first = first or (r[9], r[0], r[1], r[4])
            last = (r[0], key, r[8] > 1, r[6])
        if last:
            columns = [*([x] for x in first), *([x] for x in last)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "conv", "depth", "code", "last", "key", "branches", "smallest"])

    before: dict[int, tuple | None] = {}
    state = None
    for r in sorted(sorted_.mapInArrow(summary, "part long, conv long, depth long, code binary, last long, key binary, branches boolean, smallest long").collect()):
        before[r.part] = state
        key = bytes(r.key)
        if state and r.conv == r.last == state[0]:  # all of the conversation that went on before
            key = state[1] + (b"\0" + bytes(r.code) if state[2] else b"") + key
        state = (r.last, key, r.branches, r.smallest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv, depth, h1, h2, _, words, own, n, children, _), key, smallest in walk(batches, before):
            if conv == own:
                out.append((conv, depth, h1, h2, smallest, n, children, words, key))
            if len(out) == 4096:
                yield _batch(out, _RANKED)
                out = []
        yield _batch(out, _RANKED)

    return sorted_.mapInArrow(lean(run), RANKED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def intervals(spark, nodes: DataFrame) -> DataFrame:
    """nodes (RANKED) with n_leaves and saved_tokens, from the prefix sums at their two marks."""
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    kept = ["conv_id", "parent_conv_id", "n_convs", "n_children"]
    open_ = nodes.select(F.col("key").alias("mark"), F.col("depth").alias("tie"), *NODE, leaf.alias("leaf"), saved.alias("saved"), *kept)
    close = nodes.select(F.concat("key", F.lit(b"\1")).alias("mark"), (-F.col("depth")).alias("tie"), *NODE, F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"), *(F.lit(None).cast("long").alias(c) for c in kept))
    marks = ordered(spark, open_.unionByName(close), "mark", "tie").drop("mark", "tie")

    def sums(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([b.column(c).to_numpy().view(np.uint64) for c in ("leaf", "saved")], axis=1)

    def emit(b: pa.RecordBatch, values: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        before = total - values
        opens = b.column("n_convs").is_valid().to_numpy(zero_copy_only=False)
        both = np.where(opens[:, None], np.uint64(0) - before, total)
        columns = [pa.array(np.ascontiguousarray(both[:, k]).view(np.int64)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in (*NODE, *kept)), *columns], names=[*NODE, *kept, "leaves", "savings"])

    at = running(marks, None, sums, 2, emit, ", ".join(f"{c} long" for c in (*NODE, *kept, "leaves", "savings")))
    return at.groupBy(*NODE).agg(*(F.max(c).alias(c) for c in kept), F.sum("leaves").alias("n_leaves"), F.sum("savings").alias("saved_tokens"))


_PIECES = pa.schema([*((c, pa.int64()) for c in (*NODE, "first")), ("piece", pa.string()), ("ends_sha256", pa.string())])


def end_digests(spark, ends: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends_sha256) of (conv_id, depth, h1, h2): the ids at each node, ascending."""
    sorted_ = ordered(spark, ends.select("conv_id", *NODE), *NODE, "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of nodes that begin and end inside; of the first, the last and large ones, pieces."""
        node, ids, size, whole, out = None, [], 0, False, []

        def done(inner: bool) -> None:
            text = ",".join(map(str, ids))
            out.append((*node, ids[0], None, hashlib.sha256(text.encode()).hexdigest()) if inner else (*node, ids[0], text, None))

        for b in batches:
            for own in zip(*(b.column(c).to_pylist() for c in (*NODE, "conv_id"))):
                if own[:3] != node:
                    if node is not None:
                        done(whole)
                    whole, node, ids, size = node is not None, own[:3], [], 0
                elif size > PIECE:
                    done(False)
                    whole, ids, size = False, [], 0
                ids.append(own[3])
                size += len(str(own[3])) + 1
                if len(out) >= 256:
                    yield _batch(out, _PIECES)
                    out.clear()
        if node is not None:
            done(False)
        yield _batch(out, _PIECES)

    cut_ = cut(spark, sorted_.mapInArrow(pieces, "depth long, h1 long, h2 long, first long, piece string, ends_sha256 string"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed, out = None, None, []
        for b in batches:
            for *own, piece in zip(*(b.column(c).to_pylist() for c in (*NODE, "piece"))):
                if own != node:
                    if node is not None:
                        out.append((*node, hashed.hexdigest()))
                    node, hashed = own, hashlib.sha256(piece.encode())
                else:
                    hashed.update(b"," + piece.encode())
        if node is not None:
            out.append((*node, hashed.hexdigest()))
        yield _batch(out, pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())]))

    open_ = cut_.where("piece is not null").select(*NODE, "first", "piece").repartition(*NODE).sortWithinPartitions(*NODE, "first")
    whole = cut_.where("piece is null").select(*NODE, "ends_sha256")
    return whole.unionByName(open_.mapInArrow(joined, "depth long, h1 long, h2 long, ends_sha256 string"))


EMPTY = hashlib.sha256(b"").hexdigest()


def prefix_trie(spark, sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node of (conv_id, part, idx, code, words), in which convs (conv_id) all take part."""
    rows = prefixes(spark, sequences)
    all_ = convs.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    if not all_.n:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    nodes = nodes_of(spark, rows)
    tops = nodes.where("depth = 1").count()
    root = spark.range(1).select(
        F.lit(all_.least).alias("conv_id"), *(F.lit(0).cast("long").alias(c) for c in NODE), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(all_.n).cast("long").alias("n_convs"),
        F.lit(tops).cast("long").alias("n_children"), F.lit(0).cast("long").alias("words"), F.lit(b"").alias("key"),
    )
    done = intervals(spark, ranked(spark, with_nodes(rows, nodes), (all_.least, tops)).unionByName(root))
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("n")).select("conv_id", "n.*")
    turnless = convs.join(last, "conv_id", "left_anti").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in NODE))
    out = done.join(end_digests(spark, last.unionByName(turnless)), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op13_conversation_prefix_trie(spark, sf_dir: str) -> DataFrame:
    tune(spark, rows=10_000)
    numbered = turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    convs = cut(spark, numbered.select("conv_id").distinct())
    return prefix_trie(spark, rebuilt(numbered, convs), convs)


SQL = """
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS idx, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, 0 AS k, 4294967295::BIGINT AS c FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL
  SELECT conv_id, k + 1, CASE WHEN k % 9 = 0 THEN xor(c, ascii(substr(conv_id::VARCHAR, (k // 9 + 1)::INT, 1))::BIGINT) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 9 * length(conv_id::VARCHAR)
),
h AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM crc WHERE k = 9 * length(conv_id::VARCHAR)),
seq AS (
  SELECT h.conv_id, 0 AS part, d.idx, d.role, d.text FROM h JOIN t d ON d.conv_id = h.conv_id - ((h.conv_id % 20) + 20) % 20 AND d.idx <= h.h
  UNION ALL SELECT t.conv_id, 1, t.idx, t.role, t.text FROM t JOIN h USING (conv_id) WHERE t.idx > h.h
),
pieces AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, idx) AS depth, concat(length(role), ':', length(text), ':', role, text) AS turn, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM seq),
paths AS (SELECT conv_id, depth, words, string_agg(turn, '|') OVER (PARTITION BY conv_id ORDER BY depth) AS path, count(*) OVER (PARTITION BY conv_id) AS size FROM pieces),
members AS (
  SELECT conv_id, depth, words, path, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent, size = depth AS ends FROM paths
  UNION ALL SELECT h.conv_id, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM seq WHERE seq.conv_id = h.conv_id) FROM h
),
nodes AS (SELECT depth, path, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM members GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, parent AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, path)),
inside AS (SELECT a.depth, a.path, n.conv_id, n.depth AS d, n.saved, n.n_children, n.path AS p FROM (SELECT DISTINCT m.depth, m.path, x.depth AS xd, x.path AS xp FROM members m JOIN members x ON x.conv_id = m.conv_id AND x.depth >= m.depth) a JOIN full_ n ON n.depth = a.xd AND n.path = a.xp),
sums AS (SELECT depth, path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM inside GROUP BY depth, path)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_ f JOIN sums s USING (depth, path) LEFT JOIN full_ p ON p.depth = f.depth - 1 AND p.path = f.parent
"""
