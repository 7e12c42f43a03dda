"""Token ids of whole batches of texts, equal to the tokenizer's own.

A text's pre-tokens never span white space, so its ids are the ids of its chunks between white
space, joined. Chunks are hashed over the flat byte buffer of a batch; a table of hash -> chunk and ids,
of bounded size and kept by the worker process between tasks, holds those met before, and only
new ones go through the tokenizer, many in one call. A chunk's bytes are compared before it is given
another's ids. Texts with characters outside the set below, with a special token's string or with
a chunk that only shares another's hash go through the tokenizer whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from ledgerline.llm.common import LOWER, flat, same_bytes, word_hashes, words_of

VOCABULARY = "word_bpe_49k.json"
#: The vocabulary's own pre-tokenization, for the characters that ``plain`` lets through.
PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

CHUNK = np.ones(256, bool)
CHUNK[[9, 10, 11, 12, 13, 32]] = False
_ASCII_BAD = np.zeros(256, bool)
_ASCII_BAD[[*range(9), *range(14, 32), 127]] = True
#: Two-byte characters that take no part in composition and whose lower case has one form.
_TWO = np.zeros(1 << 16, bool)
for _lead, _seconds in {0xC2: [*range(0xA0, 0xB2), *range(0xB4, 0xB9), 0xBB, 0xBF], 0xC3: range(0x80, 0xC0), 0xD0: range(0x90, 0xC0), 0xD1: range(0x80, 0x90)}.items():
    _TWO[[(_lead << 8) + s for s in _seconds]] = True
#: Of the three-byte ones, dashes, quotation marks and the ellipsis.
_THREE = np.isin(np.arange(256), [0x93, 0x94, 0x98, 0x99, 0x9C, 0x9D, 0xA6])


def plain(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text: whether it holds nothing but characters that need no table here."""
    bad = _ASCII_BAD[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two, three = padded[lead].astype(np.int64), padded[lead + 1].astype(np.int64), padded[lead + 2]
        bad[lead] = ~(_TWO[(one << 8) + two] | ((one == 0xE2) & (two == 0x80) & _THREE[three]))
    before = np.concatenate([[0], np.cumsum(bad)])
    return before[at[1:]] == before[at[:-1]]


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return [chr(b if b in visible else 256 + rest.index(b)) for b in range(256)]


_NO_CHUNKS = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)


class Tokens:
    hashes = staticmethod(word_hashes)
    #: Chunks, and ids or bytes of chunks, kept; beyond them the table starts anew.
    KEPT, KEPT_IDS = 400_000, 4_000_000
    FRESH = 150_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = _byte_letters()
        self.letters = {chr(b): letters[b] for b in range(256)}
        suffix = self.whole.model.end_of_word_suffix
        self.ends = np.zeros(self.whole.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.whole.get_vocab().items() if t.endswith(suffix)]] = True
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.chunks, self.chunk_bytes = np.zeros(1 << 16, np.uint8), 0
        self.tables = [_NO_CHUNKS, _NO_CHUNKS]

    def _store(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def new_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of chunks stand in the pool, and how many they are."""
        found = [PRETOKENS.findall(c.lower()) for c in chunks]
        counts = np.array([len(f) for f in found], np.int64)
        text = " ".join([" ".join(f) for f in found if f])
        lettered = text.encode().decode("latin-1").translate(_SPACED(self.letters))
        ids = np.array(self.words.encode_batch_fast([lettered], add_special_tokens=False)[0].ids, np.uint32) if text else np.zeros(0, np.uint32)
        word_ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        if len(word_ends) - 1 != counts.sum():
            raise ValueError("a pre-token has no end in this vocabulary")
        bound = word_ends[np.concatenate([[0], np.cumsum(counts)])]
        return self._store(ids) + bound[:-1], np.diff(bound)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table's row of each key (ids' place and number, chunk's place and size), and whether
        it is missing."""
        row, missing = np.zeros((4, len(keys)), np.int64), np.ones(len(keys), bool)
        for known, *columns in self.tables:
            if len(known):
                k = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[k] == keys
                row[:, hit] = np.stack(columns)[:, k[hit]]
                missing &= ~hit
        return row, missing

    def _keep(self, raw: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
        """Where the bytes of new chunks stand from now on."""
        body = np.frombuffer(b"".join([raw[s:e] for s, e in zip(starts, ends)]), np.uint8)
        if self.chunk_bytes + len(body) > len(self.chunks):
            self.chunks = np.concatenate([self.chunks, np.zeros(max(len(self.chunks), len(body)), np.uint8)])
        self.chunks[self.chunk_bytes : self.chunk_bytes + len(body)] = body
        size = np.array(ends) - np.array(starts)
        at = self.chunk_bytes + np.cumsum(size) - size
        self.chunk_bytes += len(body)
        return at

    def _merge(self, a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id if given, and len + 1 offsets."""
        data, at = flat(texts)
        data = LOWER[data]
        n = len(at) - 1
        whole = ~plain(data, at)
        if data.tobytes().find(b"<|") >= 0:
            for i in range(n):
                b = data[at[i] : at[i + 1]].tobytes()
                whole[i] |= any(s.lower() in b for s in self.special)
        if len(self.tables[0][0]) > self.KEPT or self.used > self.KEPT_IDS or self.chunk_bytes > self.KEPT_IDS:
            self.clear()
        starts, ends, first = words_of(data, at, CHUNK)
        doc = np.repeat(np.arange(n), np.diff(first))
        if whole.any():
            keep = ~whole[doc]
            starts, ends, doc = starts[keep], ends[keep], doc[keep]
        hashes = self.hashes(data, starts, ends)
        keys, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        row, missing = self._find(keys)
        chunk = ends[index] - starts[index]
        unlike = ~missing
        unlike[unlike] = ~same_bytes(data, starts[index[unlike]], chunk[unlike], self.chunks, *row[2:, unlike])
        odd = unlike[inverse] | ~same_bytes(data, starts, ends - starts, data, starts[index][inverse], chunk[inverse])
        if missing.any():
            m = np.flatnonzero(missing)
            raw = data.tobytes()
            begin, end = starts[index[m]].tolist(), ends[index[m]].tolist()
            row[:2, m] = self.new_chunks([raw[s:e].decode() for s, e in zip(begin, end)])
            row[2, m], row[3, m] = self._keep(raw, begin, end), chunk[m]
            self.tables[1] = self._merge(self.tables[1], (keys[m], *row[:, m]))
            if len(self.tables[1][0]) > self.FRESH:
                self.tables = [self._merge(*self.tables), _NO_CHUNKS]
        if odd.any():
            whole[doc[odd]] = True
            keep = ~whole[doc]
            inverse, doc = inverse[keep], doc[keep]
        where, size = row[:2]
        per_word, sizes = where[inverse], size[inverse]
        pool = self.pool[: self.used]
        extra, extra_at, extra_n, extra_doc = [], [], [], []
        base = len(pool)
        for i in np.flatnonzero(whole).tolist():
            ids = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            extra.append(ids), extra_at.append(base), extra_n.append(len(ids)), extra_doc.append(i)
            base += len(ids)
        if extra:
            per_word, sizes, doc = (np.concatenate([x, np.array(y, np.int64)]) for x, y in ((per_word, extra_at), (sizes, extra_n), (doc, extra_doc)))
            order = np.argsort(doc, kind="stable")
            per_word, sizes, doc = per_word[order], sizes[order], doc[order]
        if end_id is not None:
            extra.append(np.array([end_id], np.uint32))
            after = np.searchsorted(doc, np.arange(n), side="right")
            per_word, sizes, doc = np.insert(per_word, after, base), np.insert(sizes, after, 1), np.insert(doc, after, np.arange(n))
        if extra:
            pool = np.concatenate([pool, *extra])
        total = np.cumsum(sizes)
        out = pool[np.repeat(per_word - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)]
        bound = np.concatenate([[0], total])
        return out, bound[np.searchsorted(doc, np.arange(n + 1))]


def _SPACED(letters: dict[str, str], known: dict = {}) -> dict[int, str]:  # noqa: B006 - kept on purpose
    if not known:
        known.update({ord(k): v for k, v in letters.items() if k != " "})
    return known


_loaded: dict[str, Tokens] = {}


def tokens(path: str | None = None) -> Tokens:
    """One per worker process and vocabulary, so that its table stays warm between tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]
