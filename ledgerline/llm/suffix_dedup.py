"""Removal of repeated byte strings by suffix arrays (operator 4).

Every byte covered by a 50-byte string that also starts in a document with a smaller id goes.
Equal strings meet without moving the corpus' suffixes: a window of 50 bytes is named by its
least-hashed 20-byte gram, so equal windows have equal names, and consecutive windows of one
name form a segment of 50 to 80 bytes.

1. Names: each group of documents sends its distinct names (48-bit hashes) to buckets.
2. Buckets return to each group the names that two documents have, and which of them are varied:
   stand in many different segments of a group.
3. Where there are varied names, groups send the hashes of their windows in the same way, and get
   back those that two documents have.
4. Groups send the distinct segments of the other names, and those windows, with the least document
   id of each.
5. Per bucket, the segments' suffix array is built in two stages (suffixes smaller than their
   successors are sorted directly, the others are induced by bucket scans), adjacent common
   prefixes are computed, and each window that 50 bytes tie to others gets the least id of all.
6. Groups mark the windows that an earlier document has, and cut.

Scale and skew: what is shuffled are packed byte blocks, not rows per suffix: the texts once per
pass, the names at 6 bytes for about 16 bytes of text, and segments of repeated names only.
Copies and passages count once per group of documents, however many documents hold them. A varied
name goes on window by window, dealt by the window's own hash, so a short phrase with ever
different surroundings neither gathers in one bucket nor sends what stands only once. Groups are
read in chunks and bytes are gathered in slices, so memory is bounded by the group and the bucket;
buckets are sized by the bytes they are sent. Hashes only choose what is compared; ties are decided
on the bytes. (Within one group, segments are told apart by 64 bits.) All rows that are equal in
both id and text are in one group.

Defined cases: a null text is empty; texts under 50 bytes keep all; very long texts are read whole,
in overlapping chunks; rows that repeat a doc_id are separate, and remove nothing from each other;
of equal strings the least id keeps its own, so ties between ids cannot arise; rows with a null
doc_id come after all others and remove nothing from each other; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BYTE, clean_text, cut, flat, mix, release, table, tune, word_hashes

WIDTH, GRAM = 50, 20
SPAN = WIDTH - GRAM + 1
#: Text bytes of a group of documents, bytes looked at together, bytes gathered together, bytes sent
#: to one suffix array, and the number of different segments in one group from which a name is varied.
GROUP_BYTES, CHUNK_BYTES, SLICE, BUCKET_BYTES, VARIED = 8 << 20, 1 << 18, 1 << 18, 2 << 20, 16
LAST = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            f = np.full(size, base, np.uint64)
            f[0] = 1
            _powers[key] = np.cumprod(f, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    n, size, m = len(x) - width + 1, 1, x
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[width - size : width - size + n])


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each place on, joined from powers of two."""
    x, size, out, done = BYTE[data], 1, None, 0
    while True:
        if length & size:
            n = len(data) - done - size + 1
            out = x[:n] if out is None else out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + x[done : done + n]
            done += size
        if 2 * size > length:
            return out
        x = x[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + x[size:]
        size *= 2


class Chunk:
    """The segments of some documents, or of a part of a long one: runs of window starts low..high
    (inclusive) that share a name, none across documents. first is the index of the first document,
    base the place of the chunk in the group's bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int = 0, base: int = 0):
        self.data, self.first, self.base = data, first, base
        n = len(data)
        none = np.zeros(0, np.int64)
        self.low, self.high, self.doc, self.name = none, none, none, np.zeros(0, np.uint64)
        if n < WIDTH:
            return
        with np.errstate(over="ignore"):
            gram = mix(_grams(data, GRAM))
        bits = np.uint64(max(24, n.bit_length()))
        # Leftmost of equal grams: the place stands in the low bits.
        least = _sliding_least((gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64), SPAN)
        whole = np.zeros(n + 1, np.int32)
        np.add.at(whole, np.maximum(at[1:] - WIDTH + 1, at[:-1]), 1)
        np.add.at(whole, at[1:], -1)
        good = (np.cumsum(whole)[: len(least)]) == 0
        edge = np.flatnonzero((least[1:] != least[:-1]) | (good[1:] != good[:-1])) + 1
        low = np.concatenate([[0], edge])
        high = np.concatenate([edge, [len(least)]]) - 1
        keep = good[low]
        self.low, self.high = low[keep], high[keep]
        self.name = gram[(least[self.low] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] >> np.uint64(16)
        self.doc = first + np.searchsorted(at, self.low, side="right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = _tables(len(self.data) + 1)
        with np.errstate(over="ignore"):
            if not hasattr(self, "prefix"):
                self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[self.data] * up[:-1], dtype=np.uint64)])
            return mix((self.prefix[end] - self.prefix[start]) * down[start] + (end - start).astype(np.uint64))


def chunks(data: np.ndarray, at: np.ndarray) -> Iterator[Chunk]:
    """Chunks over all documents of a group; a long document is cut into overlapping parts, so that
    each window is in one of them."""
    first = 0
    while first < len(at) - 1:
        if at[first + 1] - at[first] > CHUNK_BYTES:
            end = int(at[first + 1])
            for a in range(int(at[first]), end - WIDTH + 1, CHUNK_BYTES):
                b = min(a + CHUNK_BYTES + WIDTH - 1, end)
                yield Chunk(data[a:b], np.array([0, b - a]), first, a)
            first += 1
        else:
            last = int(np.searchsorted(at, at[first] + CHUNK_BYTES, side="right")) - 1
            yield Chunk(data[at[first] : at[last]], at[first : last + 1] - at[first], first, int(at[first]))
            first = last


def _texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return flat(t["text"]) if t.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def _ids(t: pa.Table) -> np.ndarray:
    return t["doc_id"].combine_chunks().fill_null(LAST).to_numpy() if t.num_rows else np.zeros(0, np.int64)


def _six(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where each run of equal keys begins in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def _z(a: np.ndarray) -> bytes:
    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unz(parts: list[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True) for b in parts), dtype)


def _names(n_buckets: int, many: int = VARIED):
    """Step 1 of a group: (bucket, grp, block): its distinct names. Bit 0 is set where two documents
    of the group have the name, bit 1 where it stands in ``many`` different segments."""

    def run(t: pa.Table) -> pa.Table:
        ids, grp = _ids(t), t["grp"][0].as_py()
        name, doc, segment = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for c in chunks(*_texts(t)):
            name.append(c.name >> np.uint64(2))
            doc.append(ids[c.doc])
            segment.append(c.hashes(c.low, c.high + WIDTH))
        name, doc, segment = np.concatenate(name), np.concatenate(doc), np.concatenate(segment)
        if not len(name):
            return _dealt(np.zeros(0, np.int64), name, grp)
        order = np.lexsort((segment, name))
        k, d, s = name[order], doc[order], segment[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        several = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
        varied = np.add.reduceat(np.concatenate([[1], (s[1:] != s[:-1]) | (k[1:] != k[:-1])]), starts) >= many
        x = k[starts]
        return _dealt(_bucket(x, n_buckets), x << np.uint64(2) | several.astype(np.uint64) | (varied.astype(np.uint64) << np.uint64(1)), grp)

    return run


def _bucket(name: np.ndarray, n: int) -> np.ndarray:
    return (mix(name) % np.uint64(n)).astype(np.int64)


def _dealt(bucket: np.ndarray, x: np.ndarray, grp: int) -> pa.Table:
    order, starts = _by_key(bucket)
    bounds = np.append(starts, len(order)).tolist()
    x = x[order]
    return pa.table({"bucket": pa.array(bucket[order[starts]]), "grp": pa.array([grp] * len(starts), pa.int64()), "block": pa.array([_six(x[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())})


def _repeated(t: pa.Table) -> pa.Table:
    """Steps 2 and 3, a bucket: (grp, block): each group's names that two documents have; bit 0 is
    set for names that are varied in some group."""
    groups, parts = t["grp"].to_pylist(), [_from_six(b) for b in t["block"].to_pylist()]
    n = [len(p) for p in parts]
    x, owner = np.concatenate(parts), np.repeat(np.arange(len(n), dtype=np.int32), n)
    order, starts = _by_key(x >> np.uint64(2))
    counts = np.diff(np.append(starts, len(order)))
    flags = np.bitwise_or.reduceat(x[order] & np.uint64(3), starts)
    good = np.repeat((counts > 1) | ((flags & np.uint64(1)) > 0), counts)
    varied = np.repeat(flags >> np.uint64(1), counts)
    back = order[good]
    value, who = (x[back] >> np.uint64(2) << np.uint64(1)) | varied[good], owner[back]
    by, starts = _by_key(who)
    bounds = np.append(starts, len(by)).tolist()
    return pa.table({"grp": pa.array([groups[who[by[s]]] for s in starts.tolist()], pa.int64()), "block": pa.array([_six(value[by[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())})


class Known:
    """What a group got back: its repeated names, which of them are varied, and the repeated windows
    of varied names. ``back`` has rows (kind, block), kind 0 for names and 1 for windows."""

    def __init__(self, back: pa.Table):
        kinds, blocks = back["kind"].to_pylist(), back["block"].to_pylist()
        parts = [np.sort(np.concatenate([np.zeros(0, np.uint64), *(_from_six(b) for k, b in zip(kinds, blocks) if k == kind)])) for kind in (0, 1)]
        self.names, self.varied, self.windows = parts[0] >> np.uint64(1), (parts[0] & np.uint64(1)) > 0, parts[1] >> np.uint64(1)

    def marked(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Which runs of c have a repeated name that is not varied, and which one that is."""
        hit, where = _found(self.names, c.name >> np.uint64(2))
        lots = np.zeros(len(hit), bool)
        lots[hit] = self.varied[where[hit]]
        return hit & ~lots, lots


def _found(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted ones, and where."""
    if not len(among):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    where = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[where] == keys, where


def _spread(c: Chunk, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window starts of runs, their documents and their hashes."""
    n = c.high[runs] - c.low[runs] + 1
    start = np.repeat(c.low[runs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return start, np.repeat(c.doc[runs], n), c.hashes(start, start + WIDTH)


def _windows(n_buckets: int):
    """Step 3 of a group: (bucket, grp, block): the distinct windows of its varied names. Bit 0 is
    set where two documents of the group have the window."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        known, ids = Known(back), _ids(docs)
        got = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for c in chunks(*_texts(docs)) if known.varied.any() else ():
            _, doc, h = _spread(c, np.flatnonzero(known.marked(c)[1]))
            got.append(_extremes(h >> np.uint64(18), ids[doc], ids[doc]))
        key, low, high = _extremes(*(np.concatenate(x) for x in zip(*got)))
        return _dealt(_bucket(key, n_buckets), key << np.uint64(2) | (low != high).astype(np.uint64), docs["grp"][0].as_py() if docs.num_rows else -1)

    return run


def _extremes(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys with their least low and greatest high."""
    order, starts = _by_key(key)
    if not len(order):
        return key, low, high
    return key[order[starts]], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)


def _pieces(c: Chunk, known: Known) -> tuple[np.ndarray, ...]:
    """(low, high, doc, hash, deal) of what is compared of c: runs with a repeated name, and single
    repeated windows of varied ones. deal is what buckets are dealt by."""
    whole, lots = map(np.flatnonzero, known.marked(c))
    start, doc, h = _spread(c, lots)
    keep = _found(known.windows, h >> np.uint64(18))[0]
    start, doc, h = start[keep], doc[keep], h[keep]
    low, high = np.concatenate([c.low[whole], start]), np.concatenate([c.high[whole], start])
    own = c.hashes(c.low[whole], c.high[whole] + WIDTH)
    return low, high, np.concatenate([c.doc[whole], doc]), np.concatenate([own, h]), np.concatenate([c.name[whole], h])


def _distinct(docs: pa.Table, known: Known, n_buckets: int) -> tuple | None:
    """The group's distinct segments, by bucket and hash: (bucket, hash, size, least id, where the
    bytes begin in the group's); the same in every step over the same rows."""
    got: list[tuple] = []
    ids = _ids(docs)
    for c in chunks(*_texts(docs)) if len(known.names) else ():
        low, high, doc, h, deal = _pieces(c, known)
        order, starts = _by_key(h)
        if len(starts):
            k = order[starts]
            got.append((h[k], deal[k], np.minimum.reduceat(ids[doc][order], starts), high[k] - low[k] + WIDTH, low[k] + c.base))
    if not got:
        return None
    h, deal, least, n, begin = (np.concatenate(x) for x in zip(*got))
    order, starts = _by_key(h)
    k = order[starts]
    least = np.minimum.reduceat(least[order], starts)
    bucket = (mix(deal[k]) % np.uint64(n_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return bucket[by], h[k][by], n[k][by], least[by], begin[k][by]


SEGMENTS = "bucket long, grp long, least binary, sizes binary, body binary"


def _gathered(body: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """body[b : b + n] of all pairs, joined; in slices, so that the indices made for them stay few."""
    total = np.cumsum(size)
    out, first = np.empty(int(total[-1]) if len(total) else 0, body.dtype), 0
    while first < len(size):
        before = int(total[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + SLICE, side="right")))
        n, upto = size[first:last], int(total[last - 1])
        out[before:upto] = body[np.repeat(begin[first:last] - (total[first:last] - n - before), n) + np.arange(upto - before)]
        first = last
    return out


def _segments(n_buckets: int):
    """Step 4 of a group: its distinct segments by bucket, with the least document id of each."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        out: dict[str, list] = {k.split()[0]: [] for k in SEGMENTS.split(", ")}
        if got := _distinct(docs, Known(back), n_buckets):
            bucket, _, size, least, begin = got
            data, _ = _texts(docs)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            bounds = np.append(starts, len(bucket)).tolist()
            for a, b in zip(bounds[:-1], bounds[1:]):
                row = (int(bucket[a]), docs["grp"][0].as_py(), _z(least[a:b]), _z(size[a:b].astype(np.uint8)), _z(_gathered(data, begin[a:b], size[a:b])))
                for key, v in zip(out, row):
                    out[key].append(v)
        return pa.table({k: pa.array(v, pa.int64() if k in ("bucket", "grp") else pa.binary()) for k, v in out.items()})

    return run


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Of each suffix: whether it is smaller than its successor. The empty suffix is the least."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int16) - s[:-1])
    step[-1:] = -1
    known = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(known[::-1])[::-1]
    return step[nearest] > 0


def words8(s: np.ndarray, pad: int) -> np.ndarray:
    """The 8 bytes from each place on, as one big-endian number; zeros follow the end."""
    x = np.concatenate([s, np.zeros(pad + 8, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        x = (x[:-size] << np.uint64(8 * size)) | x[size:]
    return x[: len(s) + pad]


def suffix_array(s: np.ndarray, depth: int = WIDTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of bytes s, ordered by their first ``depth`` bytes at least, in two stages:
    those smaller than their successors are sorted directly, the others follow from them by one
    scan over the buckets of first bytes.

    With ``wanted`` (a mask of places) only those suffixes are ordered, and the ones that they
    are induced from: each up to the next suffix that is smaller than its successor.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    up = smaller_than_next(s)
    need = np.ones(n, bool)
    if wanted is not None:
        upto = np.minimum.accumulate(np.where(up, np.arange(n), n - 1)[::-1])[::-1]
        change = np.zeros(n + 1, np.int64)
        places = np.flatnonzero(wanted)
        change[places] += 1
        change -= np.bincount(upto[places] + 1, minlength=n + 1)
        need = np.cumsum(change)[:n] > 0
    direct = np.flatnonzero(up & need)
    w = words8(s, depth)
    keys = [w[direct + k] for k in range(0, depth, 8)]
    keys[-1] >>= np.uint64(8 * (8 - (depth % 8 or 8)))
    direct = direct[np.lexsort(keys[::-1])]
    total = np.bincount(s[need], minlength=256)
    begin = np.cumsum(total) - total
    n_direct = np.bincount(s[direct], minlength=256)
    out = np.empty(int(total.sum()), np.int64)
    first_direct = begin + total - n_direct
    rank = np.cumsum(n_direct) - n_direct
    head = begin.copy()

    def induce(ranked: np.ndarray) -> None:
        before = ranked[ranked > 0] - 1
        before = before[need[before] & ~up[before]]
        if len(before):
            by = np.argsort(s[before], kind="stable")
            before = before[by]
            c, at, k = np.unique(s[before], return_index=True, return_counts=True)
            for first, a, m in zip(c.tolist(), at.tolist(), k.tolist()):
                out[head[first] : head[first] + m] = before[a : a + m]
                head[first] += m

    if need[-1]:
        out[head[s[-1]]] = n - 1  # it follows from the empty suffix
        head[s[-1]] += 1
    for c in range(256):
        done = begin[c]
        while done < head[c]:
            upto = head[c]
            induce(out[done:upto])
            done = upto
        own = direct[rank[c] : rank[c] + n_direct[c]]
        out[first_direct[c] : first_direct[c] + n_direct[c]] = own
        induce(own)
    return out


def common_prefixes(s: np.ndarray, order: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Of each neighbour pair of order: the length of their common prefix, ``depth`` at most."""
    w = words8(s, depth)
    a, b = order[:-1], order[1:]
    out, same = np.full(len(a), depth, np.int64), np.arange(len(a))
    for k in range(0, depth, 8):
        x = w[a[same] + k] ^ w[b[same] + k]
        differ = np.flatnonzero(x)
        lead = sum((x[differ] < np.uint64(1 << 8 * j)).astype(np.int64) for j in range(1, 8))
        out[same[differ]] = np.minimum(k + lead, depth)
        same = same[x == 0]
    return out


def least_of_windows(body: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The least id of each window of each segment (size - WIDTH + 1 windows each, in order),
    over all segments that hold its 50 bytes."""
    begin = np.cumsum(size + 1) - (size + 1)
    s = np.zeros(int((size + 1).sum()), np.uint8)  # a zero ends each segment
    inside = np.ones(len(s), bool)
    inside[begin + size] = False
    s[inside] = body
    n = size - WIDTH + 1
    starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    number = np.full(len(s), -1, np.int32)
    number[starts] = np.arange(len(starts), dtype=np.int32)
    order = suffix_array(s, wanted=number >= 0)
    order = order[number[order] >= 0]  # a window stands inside its segment: no end in it
    ids = np.repeat(least, n)[number[order]]
    run = np.concatenate([[True], common_prefixes(s, order) < WIDTH]) if len(order) else np.zeros(0, bool)
    group = np.minimum.reduceat(ids, np.flatnonzero(run))
    out = np.empty(len(starts), np.int64)
    out[number[order]] = group[np.cumsum(run) - 1]
    return out


BACK = "grp long, bucket long, counts binary, least binary"


def _segment_hashes(body: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return word_hashes(body, begin, begin + size)


def _suffixes(t: pa.Table) -> pa.Table:
    """Step 5, a bucket: to each group, for its segments in order, the least ids of their windows;
    one value stands for all windows of a segment where they agree."""
    sizes = [_unz([b], np.uint8).astype(np.int64) for b in t["sizes"].to_pylist()]
    size, body = np.concatenate(sizes), _unz(t["body"].to_pylist(), np.uint8)
    least = _unz(t["least"].to_pylist(), np.int64)
    begin = np.cumsum(size) - size
    order, starts = _by_key(_segment_hashes(body, begin, size))
    k = order[starts]
    number = np.empty(len(size), np.int64)
    number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    n_win = size[k] - WIDTH + 1
    found = least_of_windows(_gathered(body, begin[k], size[k]), size[k], np.minimum.reduceat(least[order], starts))
    first = np.cumsum(n_win) - n_win
    same = np.minimum.reduceat(found, first) == np.maximum.reduceat(found, first)
    counts = np.where(same, 1, n_win)
    out: dict[str, list] = {"grp": t["grp"].to_pylist(), "bucket": t["bucket"].to_pylist(), "counts": [], "least": []}
    at = 0
    for own in sizes:
        u = number[at : at + len(own)]
        at += len(own)
        m = counts[u]
        out["counts"].append(_z(m.astype(np.uint8)))
        out["least"].append(_z(_gathered(found, first[u], m)))
    return pa.table({c: pa.array(v, pa.int64() if c in ("grp", "bucket") else pa.binary()) for c, v in out.items()})


OUT = "doc_id long, text binary, kept binary, spans array<struct<start:long,end:long>>"


def _marks(n_buckets: int):
    """Step 6 of a group: what is left of each document, and the removed runs."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        of_names = pa.compute.greater_equal(back["kind"], 0)
        known, rows = Known(back.filter(of_names)), back.filter(pa.compute.invert(of_names)).sort_by("bucket")
        got = _distinct(docs, known, n_buckets)
        counts, least = _unz(rows["counts"].to_pylist(), np.uint8).astype(np.int64), _unz(rows["block"].to_pylist(), np.int64)
        h = np.zeros(0, np.uint64) if got is None else got[1]
        if len(counts) != len(h):
            raise RuntimeError("a group's segments changed between steps")
        at, by = np.cumsum(counts) - counts, np.argsort(h, kind="stable")
        return _cut_out(docs, known, h[by], counts[by], at[by], least)

    return run


def _cut_out(docs: pa.Table, known: Known, h: np.ndarray, counts: np.ndarray, first_of: np.ndarray, least: np.ndarray) -> pa.Table:
    (data, at), ids = _texts(docs), _ids(docs)
    step = np.zeros(len(data) + 1, np.int32)  # windows that begin here, less those that end here
    for c in chunks(data, at) if len(h) else ():
        low, high, doc, own, _ = _pieces(c, known)
        k = np.searchsorted(h, own)
        m = high - low + 1
        j = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        value = least[np.repeat(first_of[k], m) + np.where(np.repeat(counts[k], m) == 1, 0, j)]
        start = (np.repeat(low, m) + j)[value < np.repeat(ids[doc], m)]
        part = step[c.base : c.base + len(c.data) + 1]
        part += np.bincount(start, minlength=len(part)).astype(np.int32)
        part -= np.bincount(start + WIDTH, minlength=len(part)).astype(np.int32)
    gone = np.cumsum(step, dtype=np.int32)[:-1] > 0
    edge = np.zeros(len(gone) + 1, bool)
    edge[1:-1] = gone[1:] != gone[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    inside = gone[cuts[:-1]] if len(gone) else np.zeros(0, bool)
    runs, ends = cuts[:-1][inside], cuts[1:][inside]
    of = np.searchsorted(runs, at)
    base = np.repeat(at[:-1], np.diff(of))
    spans = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(runs - base), pa.array(ends - base)], ["start", "end"]))
    kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    columns = [docs["doc_id"], docs["text"]] if docs.num_rows else [pa.array([], pa.int64()), pa.array([], pa.binary())]
    return pa.table([*columns, pa.array(kept, pa.binary()), spans], ["doc_id", "text", "kept", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, varied: int = VARIED) -> DataFrame:
    """doc_id, text (UTF-8 bytes), kept (what is left of it) and spans (removed runs) of each row."""
    spark = docs.sparkSession
    tune(spark)
    plain = clean_text(docs, id_col, text_col)
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_groups = max(1, -(-int(total) // group_bytes))
    grp = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).alias("grp")
    grouped = plain.select("doc_id", F.col("text").cast("binary").alias("text"), grp)
    blocks = "bucket long, grp long, block binary"
    names = grouped.groupBy("grp").applyInArrow(_names(n_groups, varied), blocks)
    back = cut(spark, names.groupBy("bucket").applyInArrow(_repeated, "grp long, block binary").withColumn("kind", F.lit(0)))
    del names
    release(spark)
    windows = grouped.groupBy("grp").cogroup(back.groupBy("grp")).applyInArrow(_windows(n_groups), blocks)
    again = cut(spark, windows.groupBy("bucket").applyInArrow(_repeated, "grp long, block binary").withColumn("kind", F.lit(1)))
    del windows
    release(spark)
    back = back.union(again)
    sent = {r.kind: r.n // 6 for r in back.groupBy("kind").agg(F.sum(F.octet_length("block")).alias("n")).collect()}
    n_buckets = max(1, -(-(sent.get(0, 0) * (WIDTH + SPAN // 2) + sent.get(1, 0) * WIDTH) // BUCKET_BYTES))
    segments = grouped.groupBy("grp").cogroup(back.groupBy("grp")).applyInArrow(_segments(n_buckets), SEGMENTS)
    found = cut(spark, segments.groupBy("bucket").applyInArrow(_suffixes, BACK))
    del segments
    release(spark)
    known = back.select("grp", "kind", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("counts"), "block")
    all_back = found.select("grp", F.lit(-1).alias("kind"), "bucket", "counts", F.col("least").alias("block")).union(known)
    return grouped.groupBy("grp").cogroup(all_back.groupBy("grp")).applyInArrow(_marks(n_buckets), OUT)


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed")
    return done.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
