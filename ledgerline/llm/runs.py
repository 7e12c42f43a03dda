"""Periodic run detection (operator 12).

A run is a stretch of consecutive words with smallest period q, at least max(24, 3 * q) words long,
that no neighbouring word extends keeping the period.

Method: block matching. For the periods of a scale, 2**k up to 2**(k + 1) - 1 (the first scale holds
all below 16), a document is cut into aligned blocks of 2**k words (8 at the first). Whatever a run of
such a period is, one aligned block lies so far from the run's end that it occurs again one period
later. So the distinct blocks are the keys, sequences of word numbers, of one Aho-Corasick machine,
which is passed over the document; occurrences of a block at a distance of its scale are seeds, and a
seed is extended word by word in both directions. Nothing is sampled or capped, words are compared
exactly. Three exact tests keep the work small: a word of a run occurs again within one period, so
blocks with a word that doesn't are no keys; a seed that lies in a known run whose period divides
its distance belongs to that run; and a seed whose near words differ on both sides is too short.

Scale: one map over the scan, no shuffle, whole texts. A document of n words makes at most n seeds at
each of log2(n) scales, held as numpy arrays; the longest text fits a worker.

Defined cases: a null text has no words; texts that are empty, or of fewer than 24 words, have no run;
a null doc_id has no decimal form, so its text is read as it stands; repeated rows are read each; of
runs with equal exponents the one that starts first, then that with the smaller period, is named; an
empty table gives no rows; further columns are kept by ``find_runs``, but for those named as its own,
and ignored by the query.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import fields_of, lean, others, table, tune

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST, TIMES = 24, 3
#: Words of a block at the first scale: any interval of 15 places holds an aligned one.
FIRST = 8


def least_length(period):
    """The least length of a run."""
    return np.maximum(LEAST, TIMES * period)


def numbers(words: list[str]) -> np.ndarray:
    """A number for each word, the same for equal words alone."""
    seen = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


def _gaps(ids: np.ndarray) -> np.ndarray:
    """How many places on each word occurs again; the number of words where it doesn't."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    out = np.full(n, n, np.int64)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _occurrences(ids: np.ndarray, starts: np.ndarray, size: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block of each start, block, place) of the occurrences of the blocks that stand at ``starts``,
    by block and then by place; from the first start on, and up to ``high`` places after the last."""
    import ahocorasick

    base = int(starts[0])
    machine, text = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), tuple(ids[base : starts[-1] + high + size].tolist())
    known: dict[tuple, int] = {}
    own = np.empty(len(starts), np.int64)
    for k, s in enumerate((starts - base).tolist()):
        key = text[s : s + size]
        if (at := known.setdefault(key, len(known))) == len(known) - 1:
            machine.add_word(key, at)
        own[k] = at
    machine.make_automaton()
    pairs = np.fromiter(itertools.chain.from_iterable(machine.iter(text)), np.int64).reshape(-1, 2)
    order = np.argsort(pairs[:, 1], kind="stable")  # places ascend already
    return own, pairs[order, 1], pairs[order, 0] - (size - 1) + base


def _seeds(ids: np.ndarray, gaps: np.ndarray, found: list[tuple[int, int, int]], size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of blocks that occur again at a distance of low to high - 1, by place. No
    block of two periods or more is looked for where all these distances lie inside a known run."""
    far = np.concatenate([[0], np.cumsum(gaps >= high)])
    starts = np.arange(0, len(ids) - size + 1, size)
    keep = far[starts + size] == far[starts]
    for start, length, period in found:
        if size >= 2 * period:
            last = start + length - size - (high if start + length < len(ids) else 0)
            keep[-(-start // size) : max(0, last // size + 1)] = False
    starts = starts[keep]
    if not len(starts):
        return starts, starts
    own, block, place = _occurrences(ids, starts, size, high)
    key = block * (len(ids) + 1) + place
    at = own * (len(ids) + 1)
    first = np.searchsorted(key, at + np.minimum(starts + low, len(ids)))
    n = np.searchsorted(key, at + np.minimum(starts + high, len(ids) + 1)) - first
    n = np.maximum(n, 0)
    each = np.repeat(starts, n)
    which = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return each, place[which] - each


def _reaches(ids: np.ndarray, at: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """Whether a seed can be part of a run: its stretch goes on over half of what lacks, to the left
    or to the right, as four places on either side tell."""
    lack = least_length(d) - d - size
    left, right = np.ones(len(at), bool), np.ones(len(at), bool)
    for part in (1, 2, 3, 4):
        step = np.maximum(-(-lack * part // 8), 0)
        x = at - step
        left &= (x >= 0) & (ids[np.maximum(x, 0)] == ids[np.maximum(x, 0) + d])
        x = at + size - 1 + step
        inside = x + d < len(ids)
        x = np.where(inside, x, 0)
        right &= inside & (ids[x] == ids[x + np.where(inside, d, 0)])
    return left | right


def _extended(ids: np.ndarray, at: int, d: int, size: int) -> tuple[int, int]:
    """(start, end) of the longest stretch around the seed in which words d apart are equal."""
    left, right, n = at, at + size, len(ids)
    step = 64
    while left > 0:
        low = max(0, left - step)
        differ = np.flatnonzero(ids[low:left] != ids[low + d : left + d])
        if len(differ):
            left = low + int(differ[-1]) + 1
            break
        left, step = low, step * 2
    step = 64
    while right + d < n:
        high = min(n - d, right + step)
        differ = np.flatnonzero(ids[right:high] != ids[right + d : high + d])
        if len(differ):
            right += int(differ[0])
            break
        right, step = high, step * 2
    return left, right + d


def _factors(n: int) -> list[int]:
    """The primes that divide n."""
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def _primitive(ids: np.ndarray, start: int, d: int) -> bool:
    """Whether no smaller period divides d. The stretch is over twice as long as d, so a smaller
    period of it would have a divisor of d for a period."""
    return all((ids[start : start + d - d // f] != ids[start + d // f : start + d]).any() for f in _factors(d))


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then by period."""
    n, found = len(ids), []
    if n < LEAST:
        return found
    gaps, size, low = _gaps(ids), FIRST, 1
    while TIMES * low <= n:
        high = 2 * size
        at, d = _seeds(ids, gaps, found, size, low, high)
        if len(at):
            keep = _reaches(ids, at, d, size)
            for start, length, period in found:  # seeds inside known runs, at multiples of their periods
                a, b = np.searchsorted(at, (start, start + length - size - low), side="left")
                if b > a:
                    keep[a:b] &= (d[a:b] % period != 0) | (at[a:b] + d[a:b] + size > start + length)
            at, d = at[keep], d[keep]
            order = np.lexsort((at, d))
            at, d = at[order], d[order]
            k = 0
            while k < len(at):
                period = int(d[k])
                start, end = _extended(ids, int(at[k]), period, size)
                if end - start >= least_length(period) and _primitive(ids, start, period):
                    found.append((start, end - start, period))
                # The other seeds of this stretch.
                k = int(np.searchsorted(d, period, side="right")) if end == n else k + int(np.searchsorted(at[k : int(np.searchsorted(d, period, side="right"))], end - period - size, side="right"))
        size, low = high, high
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words that are searched: of one id in ten they repeat from some place on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((len(words) - a) // p + 1))[: len(words) - a]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run repeats, joined by single spaces."""
    if not runs:
        return " ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return " ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length by period, compared as fractions."""
    best = None
    for r in runs:  # by start and period: the first of equals stays
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


OUT = "runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, rebuild: bool = False) -> DataFrame:
    """All columns of docs (with doc_id and text), the runs of the text, and the text without their
    repeats. rebuild: read ``planted`` words in place of the text's own."""
    names = others(docs.columns, "runs", "collapsed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, kept = [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                words = WORD.findall(text or "")
                if rebuild:
                    words = planted(words, doc_id)
                runs = runs_of(numbers(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                kept.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found, _RUNS), pa.array(kept, pa.string())], names=[*names, "runs", "collapsed"])

    return docs.mapInArrow(lean(run), f"{fields_of(docs, names)}, {OUT}")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, runs, text in zip(b.column("doc_id").to_pylist(), b.column("runs").to_pylist(), b.column("collapsed").to_pylist()):
                runs = [(r["start"], r["length"], r["period"]) for r in runs]
                best = strongest(runs) or (None, None, None)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                milli = None if best[0] is None else 1000 * best[1] // best[2]
                rows.append((doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.string()] * 2)] if rows else [pa.array([], t) for t in [pa.int64()] * 6 + [pa.string()] * 2]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return find_runs(docs, rebuild=True).drop("text").mapInArrow(run, ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in NAMES))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
