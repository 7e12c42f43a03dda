"""Quality classifier: an additive model with pairwise interactions (operator 1).

Each text becomes a few shape features (lengths, shares of character kinds, repetition). The
model is a lookup table per feature bin and per bin pair of a few chosen feature pairs, learned
by cyclic boosting: round after round, each table in turn gets a shallow tree fitted to what
the others leave. Scoring adds the tables' values at each row's bins, vectorised.

Scale: scoring is one map over the scan, without a shuffle. Training takes at most
``TRAIN_ROWS`` labelled rows (those with the least hash of their id), whose features, not texts,
go to the driver; the tables are a few kilobytes.

Defined cases: a null text is the empty one and gets a score; very long texts are read whole; of equal
gains the first cut and feature are taken, and labelled rows are taken in the order of a hash of their
ids, then by id, label and text, so ties never depend on the run; rows of labels with a null id or
label teach nothing; without labels of both kinds every score is the share of label 1, or 0.5
without labels; repeated rows are scored each; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import clean_text, crc_mod, fields_of, flat, lean, others, table, tune, word_hashes, words_of
from ledgerline.llm.tokens import CHUNK

#: Labelled rows that training takes at most; bins, rounds and pairs of the model.
TRAIN_ROWS, BINS, COARSE, ROUNDS, PAIRS, RATE = 20_000, 32, 8, 60, 6, 0.15
THRESHOLD = 0.3

NAMES = ("log_words", "word_length", "symbols", "capitals", "digits", "beyond_ascii", "distinct_words", "repeats", "symbol_ends", "lines", "distinct_lines", "marks", "short_words", "distinct_pairs", "controls")
_KIND = np.full(256, 4, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 symbol, 5 mark, 6 beyond ASCII, 7 control
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[:32] = 0, 1, 2, 6, 7
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 5


def _distinct(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Distinct values between each two bounds."""
    values = values.copy()
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[bound[:-1][np.diff(bound) > 0]] = True
    return np.diff(np.concatenate([[0], np.cumsum(new)])[bound])


def features(texts: pa.Array) -> np.ndarray:
    """One row of NAMES per text."""
    data, at = flat(texts)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(doc * 8 + _KIND[data], minlength=8 * n).reshape(n, 8).astype(float)
    starts, ends, first = words_of(data, at, CHUNK)
    words, count = word_hashes(data, starts, ends), np.diff(first)
    per_word = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first]) / np.maximum(count, 1)
    line_class = np.ones(256, bool)
    line_class[10] = False
    l_starts, l_ends, l_first = words_of(data, at, line_class)
    lines, n_lines = word_hashes(data, l_starts, l_ends), np.diff(l_first)
    # A text's first word has none before it, its last none behind, whatever else is in the batch.
    same, goes_on = np.zeros(len(words), bool), np.ones(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][count > 0]] = False
    goes_on[first[1:][count > 0] - 1] = False
    with np.errstate(over="ignore"):
        two = words.copy()
        two[:-1] += np.where(goes_on[:-1], words[1:] * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
    last = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    solid = np.maximum(kinds.sum(axis=1) - kinds[:, 3], 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    some = np.maximum(count, 1)
    columns = (
        np.log1p(count), per_word(ends - starts), kinds[:, 4] / solid, kinds[:, 1] / letters, kinds[:, 2] / solid, kinds[:, 6] / solid,
        _distinct(words, first) / some, per_word(same), per_word(last == 4), n_lines / some, _distinct(lines, l_first) / np.maximum(n_lines, 1), kinds[:, 5] / solid, per_word(ends - starts <= 3), _distinct(two, first) / some, kinds[:, 7] / solid,
    )
    return np.column_stack(columns) if n else np.zeros((0, len(NAMES)))


@dataclass
class Additive:
    """intercept + sum of tables[f][bin of feature f] + sum of pair tables, on the log-odds scale."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
            z += values[np.searchsorted(edges, x[:, f], side="right")]
        bins = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for p in self.pairs for f in p[:2]}
        for i, j, values in self.pairs:
            z += values[bins[i], bins[j]]
        return 1 / (1 + np.exp(-z))


def _cuts(x: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of bins in two: its gain, and the first bin of the right side."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values of a tree with at most two cuts over the bins of one feature."""
    parts = [(0, len(g))]
    for _ in range(2):
        tried = [(*_split(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, k, a, b = max(tried)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values of a tree that cuts one feature, then the other on either side."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, k = _split(a.sum(axis=1), b.sum(axis=1))
        grid, gain = np.zeros_like(a), 0.0
        for part in (slice(0, k), slice(k, None)):
            u, v = a[part].sum(axis=0), b[part].sum(axis=0)
            _, m = _split(u, v)
            for side in (slice(0, m), slice(m, None)):
                gain += float(_gain(u[side].sum(), v[side].sum()))
                grid[part, side] = u[side].sum() / (v[side].sum() + 1)
        if gain > best:
            best, out = gain, grid.T if turned else grid
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Additive(float(np.log(share / (1 - share))))
    n_features = x.shape[1]
    model = Additive(float(np.log(share / (1 - share))), [_cuts(x[:, f], BINS) for f in range(n_features)], [_cuts(x[:, f], COARSE) for f in range(n_features)])
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    small = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _shallow(np.bincount(b, g, len(model.tables[f])), np.bincount(b, h, len(model.tables[f])))
            model.tables[f] += step
            z += step[b]
    g, h = slopes()
    shapes = [len(e) + 1 for e in model.coarse]
    cell = lambda i, j: small[i] * shapes[j] + small[j]
    grid = lambda v, i, j: np.bincount(cell(i, j), v, shapes[i] * shapes[j]).reshape(shapes[i], shapes[j])
    gains = [(float(_gain(grid(g, i, j), grid(h, i, j)).sum()), i, j) for i in range(n_features) for j in range(i)]
    model.pairs = [(i, j, np.zeros((shapes[i], shapes[j]))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(ROUNDS // 2):
        for i, j, values in model.pairs:
            g, h = slopes()
            step = RATE * _shallow_pair(grid(g, i, j), grid(h, i, j))
            values += step
            z += step[small[i], small[j]]
    return model


def sample_of(docs: DataFrame, labels: DataFrame, label: str, learn, rows: int) -> DataFrame:
    """(doc_id, text, y, pick) of at most ``rows`` labelled documents with learn(doc_id) true; pick is a
    hash of the text, by which rows that repeat a doc_id are told apart."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    # At most ``rows`` rows of 12 bytes are broadcast.
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", F.xxhash64("text").alias("pick"))


def taught(found: DataFrame, rows: int) -> list:
    """At most ``rows`` rows (doc_id, y, pick, x) of what was learned from a sample, the same in every run."""
    order = ("doc_id", "y", "pick")
    return sorted(found.orderBy(F.xxhash64("doc_id"), *order).limit(rows).collect(), key=lambda r: tuple(r[c] for c in order))


def train(docs: DataFrame, labels: DataFrame, learn, rows: int = TRAIN_ROWS) -> Additive:
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("pick", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array(list(features(b.column("text"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "y", "pick")), x], schema=schema)

    found = sample_of(docs, labels, "quality", learn, rows).mapInArrow(lean(run), "doc_id long, y int, pick long, x array<double>")
    got = taught(found, rows)
    return fit(np.array([r.x for r in got]).reshape(len(got), len(NAMES)), np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """All columns of docs (with text), and score, which takes the place of a column of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array(model.score(features(b.column("text"))))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), scores], names=[*names, "score"])

    names = others(docs.columns, "score")
    return docs.mapInArrow(lean(run), f"{fields_of(docs, names)}, score double")


def held_out():
    return crc_mod("doc_id", 5) == 0


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = clean_text(table(spark, sf_dir, "documents"))
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
