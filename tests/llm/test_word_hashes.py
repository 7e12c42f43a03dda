"""Words that a weak hash would take for one another."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import common, decontaminate, near_dup, packing, token_output
from ledgerline.llm.tokens import CHUNK, VOCABULARY, Tokens

A, B = "a" * 65536, "b" * 65536
#: Pairs that differ in the order of their blocks only.
PAIRS = [(A + B, B + A), ("ab" * 512, "ba" * 512), ("x" * 8 + "y" * 8, "y" * 8 + "x" * 8), ("a" * 1023 + "b", "b" + "a" * 1023)]


def words(texts):
    data, at = common.flat(pa.array(texts))
    return data, *common.words_of(data, at, CHUNK)[:2]


def test_hashes_and_bytes_tell_words_apart():
    r = random.Random(2)
    for _ in range(100):
        data, starts, ends = words(["".join(r.choice("ab ") for _ in range(300)), "".join(r.choice("a ") for _ in range(300))])
        own, hashes = [data[s:e].tobytes() for s, e in zip(starts, ends)], common.word_hashes(data, starts, ends)
        assert len(set(own)) == len(set(hashes.tolist())) == len(set(zip(own, hashes.tolist())))
        j = np.array([r.randrange(len(own)) for _ in own])
        same = common.same_bytes(data, starts, ends - starts, data, starts[j], (ends - starts)[j])
        assert same.tolist() == [own[i] == own[k] for i, k in enumerate(j)]
    for a, b in PAIRS:
        assert len(set(common.word_hashes(*words([a, b])).tolist())) == 2


def test_slices_do_not_change_hashes(monkeypatch):
    data, starts, ends = words(["x" * 5000 + " yy " + "z" * 100, " ".join("w" * k for k in range(1, 60))])
    whole = common.word_hashes(data, starts, ends)
    monkeypatch.setattr(common, "SLICE", 64)
    assert (common.word_hashes(data, starts, ends) == whole).all()
    assert common.same_bytes(data, starts, ends - starts, data, starts, ends - starts).all()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return Tokens(public_tokenizers.path(VOCABULARY))


def encoded(tokenizer, texts):
    ids, at = tokenizer.encode(pa.array(texts))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("pair", PAIRS)
def test_ids_of_such_pairs(tokenizer, pair):
    want = [tokenizer.whole.encode(t, add_special_tokens=False).ids for t in pair]
    assert encoded(tokenizer, list(pair)) == want  # in one batch
    assert [encoded(tokenizer, [t])[0] for t in pair] == want  # and in two


def test_ids_are_right_where_hashes_collide(tokenizer, monkeypatch):
    monkeypatch.setattr(tokenizer, "hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(5), raising=False)
    tokenizer.clear()
    texts = ["one two three four", "", None, "eno owt eerht ruof", "three one two", "four four 12 34"]
    for part in (texts, texts[::-1]):
        assert encoded(tokenizer, part) == [tokenizer.whole.encode(t or "", add_special_tokens=False).ids for t in part]
    tokenizer.clear()


def test_operators_tell_such_pairs_apart(spark, tokenizer):
    rows = [(2 * k + j, t) for k, pair in enumerate(PAIRS) for j, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    assert all(got[i].component_id == i and got[i].kept for i, _ in rows)
    bench = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(PAIRS)], "item_id long, text string")
    hit = {r.doc_id: r.items for r in decontaminate.match(docs, bench).collect()}
    assert hit == {i: [str(i // 2)] if i % 2 == 0 else [] for i, _ in rows}
    want = {i: [*tokenizer.whole.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    for r in packing.pack(docs).collect():
        part = want[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(want[r.doc_id]), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows_ = token_output.sequences(docs, block_bytes=1 << 16).collect()
    assert len({r.sequence_id >> 24 for r in rows_}) > 3  # blocks are bounded by bytes
    got = {}
    for r in rows_:
        ids = np.frombuffer(r.input_ids, "<u4").tolist()
        for i, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            got.setdefault(i, {})[s] = ids[a:b]
    assert {i: sum((x[s] for s in sorted(x)), []) for i, x in got.items()} == want


def test_windows_with_colliding_terms(monkeypatch):
    real = common.word_hashes
    clash = staticmethod(lambda data, starts, ends, seed=0: real(data, starts, ends, seed) % np.uint64(3 if seed < 2 else 1 << 40))
    monkeypatch.setattr(decontaminate.Windows, "hashes", clash)
    windows = decontaminate.Windows([1], ["aa bb cc dd"])
    assert windows.seed == 2 and len(windows.terms) == 4
    shard = decontaminate.Shard(pa.array(["xx aa bb cc dd", "aa bb cc ee"]), windows)
    assert [x.tolist() for x in shard.phrases()] == [[0], [1]]
