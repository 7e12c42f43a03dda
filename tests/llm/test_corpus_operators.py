"""Suffix arrays, near-duplicates, exact top-k and the pipeline against plain versions."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import near_dup, suffix_dedup, topk
from ledgerline.llm.components import components
from tests.conftest import SF, same_rows

DOCS = "doc_id long, text string, kept string, component_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


# ---- suffix arrays


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=0, max_size=200), st.integers(1, 4))
def test_suffix_array_in_two_stages(data, alphabet):
    s = np.frombuffer(bytes(b % alphabet for b in data), np.uint8)
    order = suffix_dedup.suffix_array(s)
    raw = s.tobytes()
    keys = [raw[i : i + suffix_dedup.WIDTH] for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(s)))
    wanted = np.array([b % 3 == 0 for b in data], bool)
    some = suffix_dedup.suffix_array(s, wanted=wanted)
    assert set(np.flatnonzero(wanted).tolist()) <= set(some.tolist()) and len(set(some.tolist())) == len(some)
    assert [raw[i : i + suffix_dedup.WIDTH] for i in some] == sorted(raw[i : i + suffix_dedup.WIDTH] for i in some)
    up = suffix_dedup.smaller_than_next(s)
    assert all(up[i] == (raw[i:] < raw[i + 1 :]) for i in range(len(s)))


def plain_repeats(rows):
    """Per row: the kept bytes, by the definition."""
    data = [((t or "").encode(), i) for i, t in rows]
    least = {}
    for b, i in data:
        for p in range(len(b) - 49):
            w, key = b[p : p + 50], (i is None, i or 0)
            least[w] = min(least.get(w, key), key)
    out = []
    for b, i in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < (i is None, i or 0):
                gone[p : p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes() if b else b""
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum()), kept))
    return out


def repeat_rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, phrase, line = text(60), text(9)[:40], text(40)
    rows = [(i, text(r.randint(1, 40))) for i in range(30)]
    rows += [(100 + i, text(5) + " " + line + " " + text(5)) for i in range(12)]
    rows += [(200 + i, text(12) + phrase + text(12)) for i in range(20)]  # a short phrase, ever different around it
    rows += [(300 + i, base) for i in range(6)] + [(7, base), (301, base), (None, base), (None, base + "!"), (400, None), (401, ""), (402, "a" * 49), (403, "a" * 300), (404, "a" * 60), (405, "\x00" * 70), (406, "b" + "\x00" * 60)]
    return rows


@pytest.mark.parametrize(("group_bytes", "varied"), [(8 << 20, 16), (1500, 16), (1500, 2)])
def test_removal_equals_brute_force(spark, group_bytes, varied):
    rows = repeat_rows()
    got = suffix_dedup.remove_repeats(docs(spark, rows), group_bytes=group_bytes, varied=varied).collect()
    have = sorted((-1 if r.doc_id is None else r.doc_id, len(r.text), sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got)
    assert have == sorted((-1 if i is None else i, *rest) for i, *rest in plain_repeats(rows))


def test_chunks_hold_each_window_once(monkeypatch):
    """Also where a document is longer than a chunk."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 130)
    rng = np.random.default_rng(7)
    sizes = [0, 49, 50, 51, 130, 131, 180, 181, 700, 3, 60, 60]
    data, at = rng.integers(97, 100, sum(sizes)).astype(np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    found = [(d, c.base + w) for c in suffix_dedup.chunks(data, at) for low, high, d in zip(c.low, c.high, c.doc) for w in range(low, high + 1)]
    assert sorted(found) == [(d, w) for d, n in enumerate(sizes) for w in range(at[d], at[d] + n - 49)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=150), st.integers(1, 3))
def test_common_prefixes(data, alphabet):
    s = np.frombuffer(bytes(b % alphabet + 1 for b in data), np.uint8)
    order = suffix_dedup.suffix_array(s)
    raw, want = s.tobytes(), []
    for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
        x, y = raw[a : a + 50].ljust(50, b"\0"), raw[b : b + 50].ljust(50, b"\0")
        want.append(next((k for k in range(50) if x[k] != y[k]), 50))
    assert suffix_dedup.common_prefixes(s, order).tolist() == want


def test_gathered_in_slices(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 10)
    body, begin, size = np.arange(100, dtype=np.uint8), np.array([3, 0, 50, 20, 99, 7]), np.array([5, 30, 0, 9, 1, 4])
    want = np.concatenate([body[b : b + n] for b, n in zip(begin, size)])
    assert (suffix_dedup._gathered(body, begin, size) == want).all()


def test_removal_of_nothing(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [(1, "x")]).where("false")).count() == 0
    assert [r.spans for r in suffix_dedup.remove_repeats(docs(spark, [(1, "short"), (2, None)])).collect()] == [[], []]


# ---- near-duplicates


def plain_near(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = {i: i for i, _ in rows if i is not None}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(s), -1 if i is None else root(i), i is None or root(i) == i) for (i, _), s in zip(rows, sets))


def near_rows(n=40):
    r = random.Random(3)
    words = lambda k: [f"w{r.randint(0, 400)}" for _ in range(k)]
    rows = []
    for f in range(n):
        base = words(r.randint(3, 120))
        for c in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = "edit" + str(r.randint(0, 9))
            rows.append((len(rows) * 3 % 1009, " ".join(w)))
    shared = words(12)
    rows += [(2000 + i, " ".join(words(30) + shared)) for i in range(25)]
    return rows + [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "ONE\ttwo"), (None, "one two"), (None, None), (3005, "x " * 3000), (3003, "one two")]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in got) == plain_near(rows)


def test_large_nodes_lose_no_link(spark, monkeypatch):
    """With tiny bounds nodes are large and blocks many: slabs, pivots, branching and closing all run."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(60)] = f"e{r.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    for slab, block, levels, hot in ((4, 900, 3, 10_000), (4, 900, 2, 12), (4096, 900, 1, 1)):
        monkeypatch.setattr(near_dup, "SLAB", slab)
        monkeypatch.setattr(near_dup, "HOT_NODES", hot)  # all large nodes, some or none are broadcast
        monkeypatch.setattr(near_dup, "BLOCK_BYTES", block)
        monkeypatch.setattr(near_dup, "LEVELS", levels)
        got = near_dup.near_duplicates(docs(spark, rows)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == plain_near(rows)


def test_only_rows_that_go_on_are_labelled_anew(spark, monkeypatch):
    """Beside a large group stand documents that meet nobody: they are labelled once, at the end,
    however many levels the group goes through."""
    r, n, alone, written = random.Random(5), 40, 200, []
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"e{i}" if k == r.randrange(60) else w for k, w in enumerate(base))) for i in range(n)]
    rows += [(1000 + i, " ".join(f"x{i}y{k}" for k in range(20))) for i in range(alone)]

    def noted(spark, df, own=near_dup.cut):
        out = own(spark, df)
        if out.columns == ["set_id", "rep", "n_shingles", "comp"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "SLAB", 4)
    monkeypatch.setattr(near_dup, "cut", noted)
    got = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == plain_near(rows)
    assert len(written) > 2 and sum(written) <= alone + n * len(written)


def test_pairs_stay_together_at_any_depth(spark):
    """Of pairs at the threshold, 0.98 share a node of one tree's branches however deep it goes."""
    rng, pairs, nodes = np.random.default_rng(4), [], []
    for p in range(600):
        x = rng.integers(0, 1 << 16, near_dup.COORDINATES).astype(np.uint16)
        y = np.where(rng.random(near_dup.COORDINATES) < 0.75, x, x ^ np.uint16(1))
        pairs += [(p, 2 * p), (p, 2 * p + 1)]
        nodes += [(2 * p + k, bytearray(s.astype(np.uint16).tobytes())) for k, s in enumerate((x, y))]
    at = spark.createDataFrame(pairs, "node long, a long")
    for _ in range(5):
        at = near_dup._children(at, spark.createDataFrame(nodes, "set_id long, sig binary"))
    kept = at.withColumn("pair", F.floor(F.col("a") / 2)).groupBy("node", "pair").agg(F.countDistinct("a").alias("n")).where("n = 2").select("pair").distinct().count()
    assert kept / 600 > 0.96  # 0.98 for independent paths, 0.92 if a level's nodes share coordinates


def test_recall_at_the_threshold(spark):
    """400 pairs whose similarity is 0.75 to 0.79, and 100 just below: all of the first are linked,
    none of the others."""
    r, rows = random.Random(11), []
    for p in range(500):
        words = [f"w{p}x{i}" for i in range(200)]
        n = 25 if p >= 400 else 20 + p % 5  # of 196 shingles n + 4 change
        at = r.randrange(4, 196 - n)
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join([*words[:at], *(f"z{p}x{i}" for i in range(n)), *words[at + n :]]))]
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert sum(got[2 * p + 1] == 2 * p for p in range(400)) == 400 and sum(got[2 * p + 1] == 2 * p for p in range(400, 500)) == 0


def test_a_group_gives_at_most_as_many_pairs_as_rows():
    """What is given joins all that is likely, and what is left out is named."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, near_dup.COORDINATES).astype(np.uint16)
    sig = np.stack([np.where(rng.random(near_dup.COORDINATES) < 0.85, base, rng.integers(0, 1 << 16, near_dup.COORDINATES)) for _ in range(200)]).astype(np.uint16)
    comp = rng.integers(0, 120, 200)
    found, left = near_dup._group_pairs(sig, comp)
    weight = near_dup.estimates(sig, comp[:, None] != comp[None])
    assert len(found) <= 200 and set(left.tolist()) == set(np.flatnonzero(weight.any(axis=1)).tolist())

    def classes(pairs):
        top = {c: c for c in comp.tolist()}
        root = lambda c: c if top[c] == c else root(top[c])
        for i, j in pairs:
            top[root(comp[i])] = root(comp[j])
        return {frozenset(c for c in top if root(c) == r) for r in map(root, top)}

    assert classes(found) == classes(zip(*np.nonzero(weight)))
    assert all(weight[i, j] for i, j in found)


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(docs(spark, [(1, "a")]).where("false")).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    long, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = near_dup.near_duplicates(docs(spark, [(5, long), (5, other), (9, other), (7, long)])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (9, 5)}


def test_estimates_are_unbiased():
    import pyarrow as pa

    r = random.Random(1)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(400)]
    texts = [" ".join(base)] + [" ".join(base[k:] + [f"n{k}{i}" for i in range(k)]) for k in (20, 60, 120)]
    sets, bound = near_dup.shingles(pa.array(texts))
    sig = near_dup.minwise(sets, bound)
    whole = [set(sets[a:b].tolist()) for a, b in zip(bound[:-1], bound[1:])]
    for i in (1, 2, 3):
        j = len(whole[0] & whole[i]) / len(whole[0] | whole[i])
        assert abs((sig[0] == sig[i]).mean() - j) < 0.18


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (3, 2), (5, 5), (9, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys((1, 2, 3, 9), 1)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- top-k


def plain_top(rows, k, every):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, np.floor(np.array(v, float) * 1024)) for i, v in ok]
    out = []
    for i, q in whole:
        if i % every == 0:
            scored = sorted((-int(q[: min(len(q), len(v))] @ v[: min(len(q), len(v))]), j) for j, v in whole if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 16)]) for i in range(900)]
    rows += [(1000, [0.0] * 16), (1001, None), (1100, [1.0, None] + [0.0] * 14), (1200, [float("nan")] + [0.0] * 15), (1300, [float("inf")] * 16), (1400, []), (1500, [0.5] * 4), (None, [1.0] * 16), (1600, [-0.25] * 16), (1601, [-0.25] * 16), (1602, [-0.25] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(5)
    whole = topk.whole_vectors(df)
    for query_bytes in (16 << 20, 600):
        got = topk.top_k(whole, whole.where("vec_id % 100 = 0"), query_bytes=query_bytes)
        assert sorted(map(tuple, got.collect())) == plain_top(rows, 10, 100)
    assert topk.top_k(whole.where("false"), whole.where("false")).count() == 0
    few = whole.where("vec_id < 3")
    assert sorted(map(tuple, topk.top_k(few, few.where("vec_id = 0")).collect())) == plain_top(rows[:3], 10, 100)


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(4)
    x, q = np.floor(rng.normal(0, 300, (200, 8))), np.floor(rng.normal(0, 300, (5, 8)))
    lists, exact = topk.Lists(x), q @ x.T
    for depth in (1, 10, 50, 150, 199):
        low, high = lists.bounds(q, depth)
        assert (low <= exact + 1e-6).all() and (exact <= high + 1e-6).all()


# ---- queries with SQL, and the pipeline


@pytest.mark.parametrize("name", ["op6_minhash_near_dedup", "op9_decontamination", "op10_exact_top_k"])
def test_query_equals_sql(spark, name):
    from ledgerline.llm.queries import oracle_sql, queries

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert same_rows(queries()[name](spark, SF).toPandas(), c.execute(oracle_sql()[name]).df())


def test_op4_digest(spark):
    rows = {r.doc_id: r for r in suffix_dedup.op4_suffix_array_dedup(spark, SF).collect()}
    source = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for i, n, gone, spans, kept in plain_repeats(source):
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = d.limit(40).withColumns({c: F.lit("mine") for c in ("score", "spans", "n_words", "kept")}).unionByName(spark.createDataFrame([(None, None, None, None, None, "a", "b", "c", "d"), (-1, "", "en", "s", 0, "a", "b", "c", "d")], "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, n_words string, kept string"))
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.where("score not in ('mine', 'a')").count() == 0
        assert stage(spark, odd.where("false"), SF).count() == 0
    pieces = p.run(spark, SF)
    kept = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    all_ids = {r.doc_id for r in d.select("doc_id").collect()}
    assert kept < all_ids
    good = [i for i in all_ids if labels.get(i) == 1]
    junk = [i for i in all_ids if labels.get(i) == 0]
    assert np.mean([i in kept for i in good]) > 0.6 and np.mean([i in kept for i in junk]) < 0.35


def test_secret_stage_replaces_text(spark):
    import corpus_pipeline as p

    d = spark.createDataFrame([(1, "token=abcdefgh1234", "en", "s", 18), (2, "clean", "en", "s", 5), (3, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in p.secrets_stage(spark, d, SF).collect()}
    assert got == {1: ("[SECRET]", 8), 2: ("clean", 5), 3: (None, None)}
