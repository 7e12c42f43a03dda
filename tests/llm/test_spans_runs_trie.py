"""Operators 11 to 13 against brute force, and what they make of odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import prefix_trie, private_data, runs
from ledgerline.llm.queries import queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def luhn(digits):
        doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(digits[::-1])]
        return sum(d if d < 10 else d - 9 for d in doubled) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], private_data.PLACE[s[0]]))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_are_those_of_the_expressions():
    r = random.Random(3)
    for _ in range(8000):
        text = "".join(r.choice(r.choice(["ab@.-", "0123456789 -.", "+1() .-57", "@a.b-c%", "é\n٣x"])) for _ in range(r.randrange(60)))
        got = [c[:3] for c in private_data.candidates(text) if c[3]]
        assert got == plain_spans(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "a@" * 100_000, "1" * 300_000, "1 " * 150_000, "A1" * 150_000, "a.b" * 100_000 + "@"])
def test_long_texts_take_linear_time(text):
    assert isinstance(private_data.candidates(text), list)


def test_reliabilities_tell_a_good_labeler_from_a_coin():
    r = random.Random(1)
    counts = {}
    for _ in range(5000):
        true = r.random() < 0.5
        vote = [0] * 8
        for k in range(4):  # four good labelers
            vote[k] = (1 if true else 2) if r.random() < 0.9 else (2 if true else 1)
        vote[4] = r.choice((1, 2))  # and a coin
        packed = int("".join(map(str, vote)), 3)
        counts[packed] = counts.get(packed, 0) + 1
    posterior, theta = private_data.reliabilities([("ip", v, n) for v, n in counts.items()])
    assert theta["ip"][0, 0, 1] > 0.8 and theta["ip"][1, 0, 2] > 0.8
    assert abs(theta["ip"][0, 4, 1] - 0.5) < 0.1
    assert posterior["ip", int("11110000", 3)] > 0.95 if ("ip", int("11110000", 3)) in posterior else True


def test_classifier_learns_soft_labels():
    weights = private_data.logistic([[1, 2], [1, 3]] * 200, np.array([0.9, 0.1] * 200))
    assert 0.8 < 1 / (1 + np.exp(-weights[[1, 2]].sum())) < 0.95


def _found(spark, rows, schema="doc_id long, text string"):
    found = private_data.find(spark.createDataFrame(rows, schema))
    return private_data.decide(found, private_data.fit(found))


def test_added_spans_and_odd_rows(spark):
    good = [(i, f"Please call {200 + i % 700}-555-{1000 + i} now, phone {300 + i % 600} 555 {2000 + i}. Dear Anna Meyer, write to a.b [at] mail [dot] com. ssn 123-45-{6700 + i}.") for i in range(300)]
    odd = [(1000, None), (1001, ""), (None, "mail x@example.com"), (1002, "order 123-45-6789x"), (1003, "x@example.com"), (1003, "x@example.com")]
    got = _found(spark, good + odd).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append([s.kind for s in r.spans])
    assert by_id[1000] == by_id[1001] == [[]]
    assert by_id[None] == [["email"]] and by_id[1003] == [["email"], ["email"]]
    kinds = {k for i in range(300) for k in by_id[i][0]}
    assert {"ssn", "local_phone", "spelled_email", "name"} <= kinds
    assert by_id[1002] == [[]]


def test_personal_data_of_tables_without_rows_or_candidates(spark):
    assert _found(spark, []).collect() == []
    assert [r.spans for r in _found(spark, [(1, "no such thing")]).collect()] == [[]]
    clash = _found(spark, [(1, "x@example.com", "mine", 5)], "doc_id long, text string, Found string, votes int")
    assert "votes" in clash.columns and clash.first().spans[0].kind == "email"


def test_op11_query_equals_expressions(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries()["op11_personal_data"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in private_data.BASE]
        assert set(joined(want).split(",")) <= set(r.spans.split(",")) or not want


def plain_runs(words):
    n, out = len(words), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(24, 3 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.add((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    r = random.Random(5)
    seen = 0
    for _ in range(600):
        k, parts = r.choice([1, 2, 3, 5]), []
        for _ in range(r.randrange(1, 6)):
            kind = r.random()
            if kind < 0.4:
                parts += [r.randrange(k) for _ in range(r.randrange(30))]
            elif kind < 0.8:
                p = [r.randrange(k) for _ in range(r.randrange(1, 40))]
                parts += (p * 20)[: r.randrange(1, len(p) * 6)]
            else:
                p = [r.randrange(k) for _ in range(r.randrange(1, 4))] * r.randrange(5, 20) + [9]
                parts += (p * 8)[: r.randrange(1, len(p) * 5)]
        parts = parts[:350]
        want = plain_runs(parts)
        seen += len(want)
        assert runs.runs_of(np.array(parts, np.int64)) == want
    assert seen > 500


def test_runs_of_long_texts():
    assert runs.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    word = list(range(5000))
    assert runs.runs_of(np.array(word * 3 + word[:7] + [5000], np.int64)) == [(0, 15_007, 5000)]
    assert runs.runs_of(np.array(word * 2 + word[:4999], np.int64)) == []


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a " * 23), (4, "a " * 24), (4, "a " * 24), (None, "x\x1cy " * 30), (5, "b " * 30 + "c " + "b " * 30)]
    got = runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string").withColumn("Runs", F.lit(7))).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed))
    assert found[1] == found[2] == [([], "")]
    assert found[3][0][0] == [] and found[4] == [([(0, 24, 1)], "a")] * 2
    assert found[None] == [([(0, 30, 1)], "x\x1cy")]
    assert found[5] == [([(0, 30, 1), (31, 30, 1)], "b c b")]
    assert runs.strongest([(0, 30, 1), (31, 30, 1), (70, 60, 2)]) == (0, 30, 1)
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op12_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries()["op12_periodic_runs"](spark, sf).collect()
    assert len(got) == len(docs)
    some = 0
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500:  # brute force is quadratic
            continue
        found = plain_runs(words)
        some += bool(found)
        assert r.n_runs == len(found)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
    assert some > 5


def plain_trie(rows):
    """Of (conv_id, turn, role, text) without equal turns in a conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + t[h:]
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        inside = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in nodes if len(p) == len(path) + 1 and p[:-1] == path]
        leaves = [p for p in inside if not any(len(q) == len(p) + 1 and q[:-1] == p for q in inside)]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in inside if p)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, schema="conv_id long, turn long, role string, text string"):
    numbered = prefix_trie.turns(spark.createDataFrame(rows, schema))
    convs = numbered.select("conv_id").distinct()
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(spark, prefix_trie.rebuilt(numbered, convs), convs).collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 5, 23])
def test_trie_equals_brute_force(spark, partitions):
    r = random.Random(partitions)
    rows = []
    for c in range(120):
        rows += [(c, k, r.choice(["u", None]), r.choice(["a b", "c", "", None, "d e f"])) for k in range(r.randrange(9))]
    rows += [(200, k, "u", f"long {k % 3}") for k in range(150)] + [(201, k, "u", f"long {k % 3}") for k in range(150)]
    rows += [(205, None, "u", "first"), (205, 4, "u", "later"), (None, 1, "u", "x")]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert trie(spark, rows) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_trie_of_many_ends_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    rows = [(c, 0, "u", "same") for c in range(400)]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_no_rows_and_repeated_turns(spark):
    assert trie(spark, []) == []
    got = trie(spark, [(7, 1, "u", "x"), (7, 1, "u", "x"), (7, 1, "u", "x"), (7, 1, "u", "x")])
    assert len(got) == 1 + 4 - zlib.crc32(b"7") % 4
