"""The learned queries' scores against plain versions that share no code with them but the fixed lists."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import quality, toxicity
from ledgerline.llm.queries import queries

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    return docs, labels


WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def plain_stems(taught):
    """The stems of (text, label) rows with their log-odds."""
    n, count = Counter(y for _, y in taught), {0: Counter(), 1: Counter()}
    for text, y in taught:
        own = set()
        for w in set(WORD.findall(text.lower())):
            own |= {w[:k] for k in range(4, 13) if k <= len(w)} | ({w + "$"} if len(w) >= 4 else set())
        count[y].update(own)
    odds = lambda s: math.log((count[1][s] + 0.5) / (n[1] + 1)) - math.log((count[0][s] + 0.5) / (n[0] + 1))
    tried = [s for s in count[1] if count[1][s] >= 3]
    chance = math.log(0.1 / max(1, len(tried))) / math.log(n[1] / (n[0] + n[1]))
    good = {s for s in tried if count[1][s] >= max(3, 0.005 * n[1], chance) and odds(s) >= 3 and count[0][s] <= 0.02 * count[1][s] * n[0] / n[1]}
    out = {}
    for s in good:
        if s[:-1] in good:
            continue
        while kin := [t for t in good if t[:-1] == s and len(t) == len(s) + 1 and count[1][t] >= 0.95 * count[1][s]]:
            s = max(kin, key=lambda t: (count[1][t], t))
        out[s] = odds(s)
    return out


def plain_sums(text, stems):
    """Weights by context: plain, targeted, negated, reported, threat."""
    total = [0.0] * 5
    for clause in re.split(r"[.!?;:\n]+", text.lower()):
        found, negated, reported, intends, target = [0.0] * 5, 0, False, False, False
        for w in WORD.findall(clause):
            weight = stems.get(w + "$") or next((stems[w[:k]] for k in range(4, len(w) + 1) if w[:k] in stems), None)
            kind = "insult" if weight is not None else next((k for k, words in (("harm", toxicity.HARM), ("intent", toxicity.INTENT), ("target", toxicity.TARGET), ("not", toxicity.NEGATION), ("report", toxicity.REPORT)) if w in words), "")
            negated = 3 if kind == "not" else max(0, negated - 1)
            reported, target = reported or kind == "report", target or kind == "target"
            if kind == "insult":
                found[3 if reported else 2 if negated else 0] += weight
            if kind == "harm" and intends and not negated and not reported:
                found[4] += 1.0
            intends = (intends and kind != "harm") or kind == "intent"
        if target:
            found[:2] = 0.0, found[0]
        total = [a + b for a, b in zip(total, found)]
    return total


def test_toxicity_scores_equal_a_plain_version(spark, tables):
    docs, labels = tables
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    taught = [(docs[i], labels[i].toxic) for i in docs if i in labels and labels[i].toxic in (0, 1) and not held[i]]
    stems = plain_stems(taught)
    assert stems
    x = np.log1p(np.array([plain_sums(t, stems) for t, _ in taught]))
    y, a = np.array([t[1] for t in taught], float), np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(6), np.array([0.05] * 5 + [1e-6])
    for _ in range(60):  # Newton's steps, coefficients of contexts kept at 0 or more
        p = 1 / (1 + np.exp(-(a @ w)))
        w = w + np.linalg.solve((a.T * (p * (1 - p) + 1e-6)) @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w[:5] = np.maximum(w[:5], 0)
    for r in queries()["op7_toxicity"](spark, LARGER).collect():
        want = 1 / (1 + math.exp(-float(np.log1p(plain_sums(docs[r.doc_id], stems)) @ w[:5] + w[5])))
        assert r.score == pytest.approx(want, abs=1e-6) and r.held_out == held[r.doc_id] and r.predicted == (r.score >= 0.7), r.doc_id


def plain_features(text):
    raw = text.encode()
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", raw), [x for x in raw.split(b"\n") if x]
    kind = Counter("lower" if 97 <= c < 123 else "upper" if 65 <= c < 91 else "digit" if 48 <= c < 58 else "beyond" if c >= 128 else "space" if c in b"\t\n\v\f\r " else "control" if c < 32 else "mark" if c in b".,;:'\"-?()" else "symbol" for c in raw)
    n, some = len(words), max(1, len(words))
    solid, letters = max(1, len(raw) - kind["space"]), max(1, kind["lower"] + kind["upper"])
    symbol = lambda c: not (97 <= c < 123 or 65 <= c < 91 or 48 <= c < 58 or c >= 128 or c < 33 or c in b".,;:'\"-?()")
    pairs = len(set(zip(words, words[1:]))) + (n > 0)  # the last word stands alone
    return [
        math.log1p(n), sum(map(len, words)) / some, kind["symbol"] / solid, kind["upper"] / letters, kind["digit"] / solid, kind["beyond"] / solid, len(set(words)) / some, sum(x == z for x, z in zip(words, words[1:])) / some,
        sum(symbol(w[-1]) for w in words) / some, len(lines) / some, len(set(lines)) / max(1, len(lines)), kind["mark"] / solid, sum(len(w) <= 3 for w in words) / some, pairs / some, kind["control"] / solid,
    ]


def test_quality_features_equal_a_plain_version(tables):
    docs, _ = tables
    texts = [*list(docs.values())[:300], "", " \n", "a a a\n\nb", "Ünï %% x%"]
    got = quality.features(pa.array(texts))
    for t, row in zip(texts, got):
        np.testing.assert_allclose(row, plain_features(t), rtol=1e-12)
    # What else is in the batch changes nothing.
    both = quality.features(pa.array(["a b", "b c a", "", "a b c"]))
    for t, row in zip(["a b", "b c a", "", "a b c"], both):
        np.testing.assert_array_equal(row, quality.features(pa.array([t]))[0])


def plain_score(model, x):
    z = model.intercept
    for f, (edges, values) in enumerate(zip(model.edges, model.tables)):
        z += values[sum(x[f] >= e for e in edges)]
    for i, j, values in model.pairs:
        z += values[sum(x[i] >= e for e in model.coarse[i])][sum(x[j] >= e for e in model.coarse[j])]
    return 1 / (1 + math.exp(-z))


def test_quality_scores_are_sums_of_bins(spark, tables):
    docs, labels = tables
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    got = {r.doc_id: r for r in queries()["op1_quality_classifier"](spark, LARGER).collect()}
    order = sorted((i for i in docs if i in labels and labels[i].quality in (0, 1) and not held[i]))
    x = quality.features(pa.array([docs[i] for i in order]))
    y = np.array([labels[i].quality for i in order], float)
    model = quality.fit(x, y)
    for i in list(docs)[:250]:
        want = plain_score(model, quality.features(pa.array([docs[i]]))[0])
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].held_out == held[i] and got[i].predicted == (got[i].score >= 0.3)


def test_boosting_finds_the_cuts_that_enumeration_finds():
    r = np.random.default_rng(1)
    for _ in range(50):
        g, h = r.normal(size=12), r.uniform(0.1, 0.3, 12)
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        most, best = max((gain(0, k) + gain(k, 12), k) for k in range(1, 12))
        leaves = quality._shallow(g, h)
        if most - gain(0, 12) <= 1e-9:
            assert (leaves == leaves[0]).all()
            continue
        cuts = np.flatnonzero(np.diff(leaves)) + 1
        assert best in cuts and len(cuts) <= 2
        for a, b in zip([0, *cuts], [*cuts, 12]):
            np.testing.assert_allclose(leaves[a:b], g[a:b].sum() / (h[a:b].sum() + 1))
