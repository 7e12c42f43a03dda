"""Benchmark decontamination by a positional inverted index (operator 9).

The training side is indexed: for each shard of documents, every term that occurs in the
benchmark gets a posting list of positions. A benchmark window is looked up by intersecting
the lists of its terms, each shifted by the term's place in the window, from the rarest list
on; what is left are exact phrase matches. Proximity matches ask the shifted lists for terms
within ``slop`` positions instead: a window is near where a share of its terms is.

Scale: the index is sharded by documents and a shard's lists live as long as it is looked up, so
postings never move: one map over the scan, no shuffle. The benchmark's windows are made on the
driver and broadcast, in blocks of at most ``block_bytes`` of text, checked before: a window is 52
bytes and there are fewer of them than bytes of text / 2. With more than one block the documents
are numbered and written once, each block gives the numbers and hits of documents that it hits,
written before the next one is made, and the last block's map merges them: neither the driver nor an
executor holds more than one block, and texts move once, however many blocks there are. Windows with
a term that the shard lacks (for proximity: with too many) end there.

Defined cases: null text has no words; an item or document without words matches nothing; an
item of fewer than 13 words is one window; repeated items count by item id; repeated documents
are rows of their own; null item ids are matched but not listed; of terms that are equally rare the
first in the window is looked up first, which changes no match; very long texts are read whole; words
are compared byte by byte where their hashes agree; empty tables give no hits or no rows; further
columns are kept, but for those named as the operator's own, in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, clean_text, cut, fields_of, flat, lean, others, same_bytes, table, tune, word_hashes, words_of

WINDOW, SLOP, SHARE = 13, 1, 0.8
#: Benchmark text of one block.
BLOCK_BYTES = 4 << 20
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Windows:
    """Distinct windows of benchmark items as rows of term numbers; number n_terms fills a row up.
    names: the item ids as text, sorted; those of window w are item[first[w] : first[w + 1]]."""

    hashes = staticmethod(word_hashes)

    def __init__(self, items: list, texts: list[str | None], width: int = WINDOW):
        data, at = flat(pa.array(texts, pa.string()))
        data = LOWER[data]
        starts, ends, begin = words_of(data, at, WORD)
        #: The hash under which no two different terms meet, and the terms' bytes.
        for self.seed in range(64):
            self.terms, index, number = np.unique(self.hashes(data, starts, ends, self.seed), return_index=True, return_inverse=True)
            if same_bytes(data, starts, ends - starts, data, starts[index][number], (ends - starts)[index][number]).all():
                break
        else:
            raise ValueError("no hash tells the terms of this block apart")
        self.term_size = ends[index] - starts[index]
        self.term_at = np.cumsum(self.term_size) - self.term_size
        self.term_bytes = data[np.repeat(starts[index] - self.term_at, self.term_size) + np.arange(int(self.term_size.sum()))]
        n = np.diff(begin)
        size = np.minimum(n, width)
        count = np.where(n > 0, n - size + 1, 0)
        owner = np.repeat(np.arange(len(n)), count)
        start = np.repeat(begin[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        words = np.full((len(start), width), len(self.terms), np.int32)
        for j in range(width):
            inside = np.flatnonzero(j < size[owner])
            words[inside, j] = number[start[inside] + j]
        order = np.lexsort(words.T[::-1])
        new = np.ones(len(order), bool)
        new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
        self.words, self.size = words[order[new]], size[owner[order[new]]]
        self.names = sorted({str(x) for x in items if x is not None})
        known = {x: k for k, x in enumerate(self.names)}
        name = np.array([-1 if x is None else known[str(x)] for x in items], np.int64)[owner[order]]
        pair = np.unique(np.stack([np.cumsum(new) - 1, name])[:, name >= 0], axis=1) if len(order) else np.zeros((2, 0), np.int64)
        self.item, self.first = pair[1], np.searchsorted(pair[0], np.arange(len(self.size) + 1))

    def listed(self, doc: np.ndarray, window: np.ndarray, n_docs: int) -> list[list[str]]:
        """The sorted item ids of each document's windows."""
        n = np.diff(self.first)[window]
        item = self.item[np.repeat(self.first[window] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        pairs = np.unique(np.stack([np.repeat(doc, n), item]), axis=1)
        bounds = np.searchsorted(pairs[0], np.arange(n_docs + 1)).tolist()
        return [[self.names[k] for k in pairs[1, a:b].tolist()] for a, b in zip(bounds[:-1], bounds[1:])]


class Shard:
    """Posting lists of the documents of one batch, for the terms of ``windows``, positions ascending."""

    def __init__(self, texts: pa.Array, windows: Windows):
        data, at = flat(texts)
        data = LOWER[data]
        starts, ends, self.first = words_of(data, at, WORD)
        terms, n = windows.terms, len(windows.terms)
        self.windows, self.n_words = windows, np.diff(self.first)
        term = np.full(len(starts), n, np.int64)
        if n and len(starts):
            hashes = windows.hashes(data, starts, ends, windows.seed)
            k = np.minimum(np.searchsorted(terms, hashes), n - 1)
            hit = np.flatnonzero(terms[k] == hashes)
            hit = hit[same_bytes(data, starts[hit], ends[hit] - starts[hit], windows.term_bytes, windows.term_at[k[hit]], windows.term_size[k[hit]])]
            term[hit] = k[hit]
        self.term = term
        self.positions = np.argsort(term, kind="stable")
        self.bounds = np.searchsorted(term[self.positions], np.arange(n + 1))
        #: All lists in one: (term, position), ascending.
        self.postings = term[self.positions] * (len(term) + 1) + self.positions

    def _candidates(self, live: np.ndarray, place: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of each posting of the term at place[k] of window live[k], or within slop of it."""
        t = self.windows.words[live, place]
        a, n = self.bounds[t], self.bounds[t + 1] - self.bounds[t]
        window, total = np.repeat(live, n), np.cumsum(n)
        at = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - n - a, n)
        start = self.positions[at] - np.repeat(place, n)
        doc = np.searchsorted(self.first, self.positions[at], side="right") - 1
        if slop:
            window, doc = np.repeat(window, 2 * slop + 1), np.repeat(doc, 2 * slop + 1)
            start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
        inside = (start >= self.first[doc]) & (start + self.windows.size[window] <= self.first[doc + 1])
        return window[inside], start[inside]

    def _live(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of which the shard has at least so many terms; their places, rarest list first."""
        w, n = self.windows, np.diff(self.bounds)
        live = np.flatnonzero(np.append(n > 0, False)[w.words].sum(axis=1) >= least)
        length = np.append(n, np.iinfo(np.int64).max)[w.words[live]]
        return live, np.argsort(length, axis=1, kind="stable")

    def _holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term's list holds the position."""
        wanted = term.astype(np.int64) * (len(self.term) + 1) + position
        at = np.minimum(np.searchsorted(self.postings, wanted), len(self.postings) - 1)
        return self.postings[at] == wanted

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all exact occurrences."""
        live, order = self._live(self.windows.size)
        if not len(live):
            return live, live
        window, start = self._candidates(live, order[:, 0])
        row = np.zeros(len(self.windows.size), np.int64)
        row[live] = np.arange(len(live))
        for j in range(1, order.shape[1]):
            if not len(window):
                break
            place = order[row[window], j]
            used = place < self.windows.size[window]
            keep = ~used | self._holds(self.windows.words[window, place], start + place)
            window, start = window[keep], start[keep]
        return window, start

    def near(self, slop: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all starts where at least ``share`` of the window's terms, and one,
        stand within ``slop`` positions of their place; only the whole window's place has to lie in
        the document. Any match holds, of the rarest places, two beyond those that may be missing
        (one, where one term is enough), whatever else is in the shard."""
        w, n = self.windows, len(self.windows.terms)
        needed = np.maximum(1, np.ceil(share * w.size)).astype(np.int64)
        live, order = self._live(needed)
        held = np.minimum(needed[live], 2)  # of so many places a candidate has to hold this many
        looked = w.size[live] - needed[live] + held
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for j in range(int(looked.max(initial=0))):
            rows = np.flatnonzero(j < looked)
            found.append(self._near_candidates(rows, live[rows], order[rows, j], slop))
        row, start = (np.concatenate(x) for x in zip(*found))
        key, times = np.unique(row * (len(self.term) + 1) + start, return_counts=True)
        row, start = np.divmod(key, len(self.term) + 1)
        keep = times >= held[row]
        window, start = live[row[keep]], start[keep]
        doc = np.searchsorted(self.first, start, side="right") - 1
        padded = np.concatenate([np.full(slop, n + 1), self.term, np.full(slop + w.words.shape[1], n + 1)])
        count = np.zeros(len(window), np.int64)
        for j in range(w.words.shape[1]):
            want = np.where(j < w.size[window], w.words[window, j], -1)
            there = np.zeros(len(window), bool)
            for d in range(2 * slop + 1):
                at = start + j + d - slop
                there |= (padded[at + slop] == want) & (at >= self.first[doc]) & (at < self.first[doc + 1])
            count += there
        keep = count >= needed[window]
        return window[keep], start[keep]

    def _near_candidates(self, row: np.ndarray, window: np.ndarray, place: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, start) that a posting of the term at place[k] of window[k] is within slop of."""
        found, start = self._candidates(window, place, slop)
        back = np.zeros(len(self.windows.size), np.int64)
        back[window] = row
        return np.divmod(np.unique(back[found] * (len(self.term) + 1) + start), len(self.term) + 1)


def _covered(first: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    change = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + size, -1)
    return np.cumsum(change)[:-1] > 0


#: What match() adds to a row.
STATE = {"n_words": "long", "spans": "array<struct<start:long,end:long>>", "items": "array<string>", "near_items": "array<string>"}


def _nothing() -> list:
    """The columns of STATE for a row that nothing is known of."""
    return [(F.lit(0).cast("long") if kind == "long" else F.expr(f"cast(array() as {kind})")).alias(c) for c, kind in STATE.items()]


def match(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW, slop: int = 0, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs, with n_words, spans (runs of hit words, end exclusive), items (ids of
    items with an exact occurrence, sorted as strings) and near_items (with slop > 0: those
    with a proximity match)."""
    spark = docs.sparkSession
    tune(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(size) // block_bytes))
    kept = others(docs.columns, *STATE)

    def shipped(b: int):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).collect()
        return spark.sparkContext.broadcast(Windows([r.item for r in block], [r.text for r in block], width))

    def looked_up(rows: DataFrame, windows, hit_only: bool = False) -> DataFrame:
        names = [n for n in rows.columns if not (hit_only and n == "text")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = _hits(batch, batch.schema.get_field_index("text"), windows.value, slop, share)
                yield _with_hits(done).select(names) if hit_only else done

        return rows.mapInArrow(lean(run), fields_of(rows, names))

    if n_blocks == 1:
        return looked_up(docs.select(*kept, *_nothing()), shipped(0))
    # Rows are numbered and written once. All blocks but the last give what they hit, without texts.
    place = next(n for n in (f"place_{k}" for k in range(len(kept) + 1)) if n not in [c.lower() for c in kept])
    numbered = cut(spark, docs.select(*kept, F.monotonically_increasing_id().alias(place)))
    hits = []
    for b in range(n_blocks - 1):
        windows = shipped(b)
        hits.append(cut(spark, looked_up(numbered.select(place, "text", *_nothing()), windows, hit_only=True)))
        windows.unpersist()
    lists = [c for c, kind in STATE.items() if kind != "long"]
    before = reduce(DataFrame.union, hits).groupBy(place).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in lists))
    state = [none if c == "n_words" else F.coalesce(c, none).alias(c) for c, none in zip(STATE, _nothing())]
    return looked_up(numbered.join(before, place, "left").select(*kept, *state), shipped(n_blocks - 1))


def _with_hits(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows that an exact or a proximity match stands in."""
    n = sum(pa.compute.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("spans", "near_items"))
    return batch.filter(pa.array(n > 0))


def _hits(batch: pa.RecordBatch, text_at: int, windows: Windows, slop: int, share: float) -> pa.RecordBatch:
    shard = Shard(batch.column(text_at), windows)
    first, n = shard.first, batch.num_rows
    window, start = shard.phrases()
    size = windows.size[window]
    of = lambda start: np.searchsorted(first, start, side="right") - 1
    names, near = windows.listed(of(start), window, n), [[]] * n
    old_spans = batch.column("spans").to_pylist()
    for d, spans in enumerate(old_spans):
        if spans:
            start = np.concatenate([start, [first[d] + s["start"] for s in spans]]).astype(np.int64)
            size = np.concatenate([size, [s["end"] - s["start"] for s in spans]]).astype(np.int64)
    hit = _covered(first, start, size)
    edge = np.zeros(len(hit) + 1, bool)
    edge[1:-1] = hit[1:] != hit[:-1]
    edge[0] = edge[-1] = True
    edge[first] = True
    cuts = np.flatnonzero(edge)
    runs = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if hit[a]] if len(hit) else []
    spans = [[] for _ in range(n)]
    for a, b in runs:
        d = int(np.searchsorted(first, a, side="right")) - 1
        spans[d].append({"start": a - int(first[d]), "end": b - int(first[d])})
    if slop:
        w, s = shard.near(slop, share)
        near = windows.listed(of(s), w, n)
    both = lambda new, column: [sorted({*x, *y}) if y else x for x, y in zip(new, batch.column(column).to_pylist())]
    items, nears = both(names, "items"), both(near, "near_items")
    keep = {"n_words": pa.array(shard.n_words, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "items": pa.array(items, pa.list_(pa.string())), "near_items": pa.array(nears, pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays([keep.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], names=batch.schema.names)


def judge(matched: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: at least a twentieth of the words hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return (
        matched.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = clean_text(table(spark, sf_dir, "documents"))
    found = judge(match(docs, table(spark, sf_dir, "benchmark"), slop=SLOP))
    near = F.size("near_items").cast("long").alias("n_near_items")
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", near)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
with d as (select row_number() over () as k, doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, unnest([array_to_string(w[s : s + least(13, len(w)) - 1], ' ') for s in range(1, len(w) - least(13, len(w)) + 2)]) as t,
               least(13, len(w)) as n from i where len(w) > 0),
sizes as (select distinct n from win),
dw as (select k, n, unnest(range(1, len(w) - n + 2)) as s, w from d, sizes where len(w) >= n),
hits as (select dw.k, dw.s, dw.n, win.item_id from dw join win on win.n = dw.n and win.t = array_to_string(dw.w[dw.s : dw.s + dw.n - 1], ' ')),
words as (select k, count(distinct p) as n_hit from (select distinct k, unnest(range(s, s + n)) as p from hits) group by k),
its as (select k, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct k, cast(item_id as varchar) as item from hits) group by k),
wid as (select row_number() over () as wid, t, n from (select distinct t, n from win)),
ww as (select wid, n, unnest(string_split(t, ' ')) as x, unnest(range(0, n)) as j from wid),
dp as (select k, unnest(w) as x, unnest(range(1, len(w) + 1)) as p, len(w) as m from d),
cand as (select k, wid, p - j + o as s from dp join ww using (x), (values (-{SLOP}), (0), ({SLOP})) o(o) where p - j + o between 1 and m - n + 1 group by k, wid, n, s having count(distinct j) >= greatest(1, ceil({SHARE} * n))),
near as (select k, count(distinct item_id) as n_near from (select distinct k, wid from cand) join wid using (wid) join win using (t, n) group by k)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated,
       cast(coalesce(n_near, 0) as bigint) as n_near_items
from d left join words using (k) left join its using (k) left join near using (k)
"""
