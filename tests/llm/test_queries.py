"""The registered queries' own outputs against plain versions, and hostile texts."""

import hashlib
import html.parser
import json
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, near_dup, quality, secrets, suffix_dedup, token_output, tokens, toxicity, warc
from ledgerline.llm.queries import queries
from tests.conftest import SF
from tests.llm.test_text_operators import EDGE, docs, plain_base

LARGER = "/root/testdata/sf0.01"


def table(name, where=SF):
    return duckdb.sql(f"select * from '{where}/{name}.parquet'").df()


# ---- quality


def test_op1_tells_held_out_labels_apart(spark):
    """The learned model has no SQL: its held-out accuracy stands for it."""
    got = queries()["op1_quality_classifier"](spark, LARGER).toPandas().merge(table("labels", LARGER), on="doc_id")
    crc = [zlib.crc32(str(i).encode()) for i in got.doc_id]
    assert (got.held_out == [c % 5 == 0 for c in crc]).all() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() > 0.97 and set(out.quality) == {0, 1}


def test_fit_learns_tables_and_a_pair():
    """Two features whose product alone decides: no single table can tell, a pair's does."""
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert {(1, 0), (0, 1)} & {(i, j) for i, j, _ in model.pairs}
    alone = quality.Additive(model.intercept, model.edges, model.coarse, model.tables)
    right = lambda m: ((m.score(x) > 0.5) == (y > 0.5)).mean()
    assert right(model) > 0.9 > 0.7 > right(alone)
    single = quality.fit(x, (x[:, 2] > 0.3).astype(float))
    assert ((single.score(x) > 0.5) == (x[:, 2] > 0.3)).mean() > 0.98


def test_op1_and_op7_edge_rows(spark):
    """Null and empty texts score alike, repeated rows alike, and every row has a score; a column
    named as the score, in any case, gives way to it."""
    rows = docs(spark, EDGE).withColumnRenamed("score", "Score")
    lab = spark.createDataFrame([(5, 1, 1), (5, 1, 1), (2, 0, 0), (7, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    clean = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        models = [module.train(clean, lab, F.lit(True)) for _ in range(2)]
        got = [module.score(rows, m).collect() for m in models]
        assert sorted(got[0], key=str) == sorted(got[1], key=str) and len(got[0]) == len(EDGE), label
        assert "Score" not in got[0][0].asDict() and all(0 <= r.score <= 1 for r in got[0])
        by = {}
        for r in got[0]:
            by.setdefault(r.doc_id, set()).add(r.score)
        assert by[1] == by[2] and len(by[5]) == 1


def test_repeated_ids_teach_the_same_in_every_run(spark):
    rows = [(i % 7, f"word{i} " * (i % 5 + 1)) for i in range(60)]
    lab = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7)], "doc_id long, quality int, toxic int")
    found = [[(r.doc_id, r.text) for r in quality.taught(quality.sample_of(docs(spark, rows).repartition(n), lab, "quality", F.lit(True), 9), 9)] for n in (1, 5)]
    assert found[0] == found[1] and len(found[0]) == 9


# ---- secrets


def test_op3_equals_plain(spark):
    texts = dict(zip(*(table("documents", LARGER)[c] for c in ("doc_id", "text"))))
    got = queries()["op3_secret_scans"](spark, LARGER).collect()
    assert len(got) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
    for r in got:
        base = plain_base(texts[r.doc_id] or "")
        parts = [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert ",".join(parts) == base and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in parts) for k in ("assign:", "access:", "hex:"))


def test_hex_runs_are_found_wherever_they_stand():
    r = random.Random(5)
    texts = ["".join(r.choice(("0123456789abcdef", "xyzé ", "0a")[r.randrange(3) if r.random() < 0.1 else 0]) for _ in range(r.randrange(90))) for _ in range(400)]
    texts += ["a" * n + c + "b" * m for n in range(20, 30) for m in (0, 23, 24, 25) for c in ("", "é", "Z")]
    got = secrets.hex_runs(*secrets.flat(pa.array(texts)))
    assert got == [[m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24] for t in texts]
    assert sum(map(len, got)) > 100


TEN = 10_000_000


@pytest.mark.parametrize("part", ["-----BEGIN RSA PRIVATE KEY-----\n", "-eyJ", "eyJabc.", "password", "token=", "AKIA", "0123456789abcdef0123456 ", "token:" + " " * 1000, "DE89", "-----BEGIN "], ids=lambda t: t[:12])
def test_secrets_of_ten_hostile_megabytes(part):
    began, text = time.time(), part * (TEN // len(part))
    secrets.find(text, secrets._machine(), secrets.hex_runs(*secrets.flat(pa.array([text])))[0])
    assert time.time() - began < 60


# ---- token rows


def test_op5_rows_hold_the_documents(spark):
    """Read again from the bytes, and their digest against one made here."""
    made = queries()["op5_token_output"](spark, SF)
    rows = made.collect()
    t, want, found = tokens.tokens(), {}, {}
    for i, text in zip(*(table("documents")[c] for c in ("doc_id", "text"))):
        want[i] = t.whole.encode(text or "", add_special_tokens=False).ids + [2]
    for r in rows:
        ids, places = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            found.setdefault(d, {})[s] = ids[a:b].tolist()
            assert (places[a:b] == np.arange(b - a)).all()
    assert {d: sum((p[s] for s in sorted(p)), []) for d, p in found.items()} == want
    digest = {r.sequence_id: r for r in token_output.digest(made).collect()}
    for r in rows:
        d = digest[r.sequence_id]
        assert (d.n_ids, d.width, d.n_segments) == (r.n_ids, len(r.input_ids) // 4, len(r.doc_ids))
        assert (d.ids_crc32, d.positions_crc32) == (zlib.crc32(r.input_ids), zlib.crc32(r.position_ids)) and d.cu_seqlens == r.cu_seqlens


# ---- toxicity


def plain_clause(words, stems):
    """The grammar in plain words: what each of a clause's words adds to which context."""
    kind = lambda w: next((k for k, words_ in (("harm", toxicity.HARM), ("intent", toxicity.INTENT), ("target", toxicity.TARGET), ("not", toxicity.NEGATION), ("report", toxicity.REPORT)) if w in words_), None)
    out = dict.fromkeys(toxicity.CONTEXTS, 0.0)
    aimed, meant, last_not, reported = any(kind(w) == "target" and w not in stems for w in words), False, -9, False
    for i, w in enumerate(words):
        weight = stems.get(w)
        k = None if weight is not None else kind(w)
        last_not, reported = i if k == "not" else last_not, reported or k == "report"
        negated = i - last_not < 3
        if weight is not None:
            out["reported" if reported else "negated" if negated else "targeted" if aimed else "plain"] += weight
        if k == "intent":
            meant = True
        elif k == "harm" and meant:
            meant = False
            if not negated and not reported:
                out["threat"] += 1.0
    return [out[c] for c in toxicity.CONTEXTS]


def test_clauses_equal_the_plain_grammar():
    r, stems = random.Random(8), {"idiot": 2.0, "wretch": 1.5}
    g = toxicity.Grammar({f"{s}$": w for s, w in stems.items()})
    words = [*stems, "kill", "hurt", "will", "gonna", "you", "your", "not", "never", "said", "calls", "the", "a", "dog", "runs"]
    for _ in range(4000):
        clause = r.choices(words, k=r.randrange(1, 14))
        assert g.clause(" ".join(clause)) == pytest.approx(plain_clause(clause, stems)), clause


def test_op7_tells_held_out_labels_apart(spark):
    got = queries()["op7_toxicity"](spark, LARGER).toPandas().merge(table("labels", LARGER), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.7)).all() and got.score.between(0, 1).all()
    out = got[got.held_out]
    hit = (out.predicted == 1) & (out.toxic == 1)
    assert out.toxic.sum() > 5 and hit.sum() >= 0.7 * out.toxic.sum() and hit.sum() >= 0.9 * out.predicted.sum()


# ---- WARC


class Plain(html.parser.HTMLParser):
    """Text and links as the standard library's parser sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.title, self.raw, self.in_title, self.seen = [], [], [], None, False, False

    def handle_starttag(self, tag, attrs):
        if self.raw:
            return
        a = dict(attrs)
        if tag in warc.RAW:
            self.raw = tag
        if tag == "title":
            self.in_title = not self.seen
        if tag in warc.LINE:
            self.parts.append("\n")
        if tag in ("a", "link", "area") and a.get("href") is not None:
            self.links.append(a["href"])

    def handle_endtag(self, tag):
        if self.raw:
            self.raw = None if tag == self.raw else self.raw
            return
        if tag == "title":
            self.in_title, self.seen = False, True
        if tag in warc.LINE:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.raw:
            (self.title if self.in_title else self.parts).append(data)


def test_op8_equals_the_standard_parser(spark):
    pages = table("pages")
    records = {}
    for r in queries()["op8_warc_derivatives"](spark, SF).collect():
        records.setdefault(r.page_id, {})[r.record_type] = next(warc.parse(bytes(r.record)))
    assert len(records) == pages.page_id.nunique()
    for page_id, body in zip(pages.page_id, pages.html):
        p, made = Plain(), records[page_id]
        p.feed(body or "")
        p.close()
        lines = [" ".join(x.split()) for x in "".join(p.parts).split("\n")]
        meta = json.loads(made["metadata"].block)
        assert made["conversion"].block.decode() == "\n".join(x for x in lines if x)
        assert meta["title"] == " ".join("".join(p.title).split())
        assert [x["url"].rsplit("/", 1)[-1] for x in meta["links"] if x["path"].endswith("href")] == [x.rsplit("/", 1)[-1] for x in p.links]
        assert dict(meta["source"])["WARC-Record-ID"] == made["metadata"].get("WARC-Refers-To") == made["response"].get("WARC-Record-ID")


@pytest.mark.parametrize("part", ["<a ", '<a ">" ', "<a ' ", "<script>", "<", '<a x="', "<p>", "b", "</script ", "<!--", "<a =b "], ids=lambda t: t[:9])
def test_pages_of_ten_hostile_megabytes(part):
    began, text = time.time(), "<a " + part * (TEN // len(part)) + ">"
    warc.read_html(text, "http://h/")
    assert time.time() - began < 60


def test_files_are_derived_through_spark(spark, tmp_path):
    import gzip

    plain = warc.response(1, "http://h/a", "<title>T</title><p>x")
    body = gzip.compress("<p>grüße<p>zwei".encode("latin-1"))
    chunks = b"".join(f"{len(body[a : a + 9]):x}\r\n".encode() + body[a : a + 9] + b"\r\n" for a in range(0, len(body), 9)) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nX-A: 1\r\nX-A: 2\r\n\r\n" + chunks
    packed = warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "http://h/b"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))], block)
    info = warc.Record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:i>"), ("Content-Length", "2")], b"hi")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r.to_bytes()) for r in (info, plain, packed)))
    rows = warc.file_derivatives(spark, str(tmp_path / "*.gz")).collect()
    assert len(rows) == 4 and warc.read_files(spark, str(tmp_path / "*.gz")).count() == 3
    texts = {r.refers_to: next(warc.parse(bytes(r.record))).block.decode() for r in rows if r.record_type == "conversion"}
    assert texts == {plain.get("WARC-Record-ID"): "x", "<urn:x>": "grüße\nzwei"}
    meta = next(json.loads(next(warc.parse(bytes(r.record))).block) for r in rows if r.record_type == "metadata" and r.refers_to == "<urn:x>")
    assert [h for h in meta["http"]["headers"] if h[0] == "X-A"] == [["X-A", "1"], ["X-A", "2"]]


# ---- very long texts


def test_very_long_texts(spark):
    """One text of 3 MB and a copy of it beside short ones: removed, linked, matched and scored whole."""
    r = random.Random(1)
    words = [f"w{r.randrange(40_000)}" for _ in range(450_000)]
    long, passage = " ".join(words), " ".join(f"item{k}" for k in range(20))
    rows = docs(spark, [(1, long), (2, long + " end"), (3, "short one"), (4, f"{long} {passage}")])
    kept = {x.doc_id: (len(x.text), len(x.kept)) for x in suffix_dedup.remove_repeats(rows).collect()}
    assert kept[1][0] == kept[1][1] > 2_500_000 and kept[2][1] < 60 and kept[4][1] < len(passage) + 60
    near = {x.doc_id: x.component_id for x in near_dup.near_duplicates(rows).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 1}
    hit = {x.doc_id: x.items for x in decontaminate.match(rows, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()}
    assert hit == {1: [], 2: [], 3: [], 4: ["7"]}
    g = toxicity.Grammar({"idiot$": 2.0})
    assert g.document(f"{long}. you idiot")[0][1] == 2.0
