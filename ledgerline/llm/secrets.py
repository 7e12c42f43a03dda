"""Secret scans (operator 3).

An Aho-Corasick machine of keywords passes once over each text; regular expressions are tried
only where a keyword stands, anchored there; and kinds that carry a checksum are kept only if it
holds. Long hexadecimal runs have no keyword: every eighth byte is sampled, and the expression is
tried between the bytes that bound three hexadecimal samples in a row or more.

Kinds: ``assign``, ``access`` and ``hex`` are the base. The method adds ``github`` and ``npm``
(tokens that end in six base-62 digits of the CRC-32 of what stands before), ``jwt`` (whose
first part must decode to JSON; it starts where no character of its alphabet stands before),
``iban`` (ISO 13616, remainder 97) and ``pem`` (private key blocks, each to the next end). Spans are
code points, end exclusive; added spans may overlap base ones.

Scale: one map over the scan, no shuffle, whole texts. No expression reads a place more often than a
bounded number of times, so the longest text takes time in proportion to its length.

Defined cases: a null text is empty and has no spans; spans that start together are in the order of
kinds as listed; repeated rows are scanned each; an empty table gives no rows; further columns are
kept by ``scan``, but for one named as its own, and ignored by the query.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import clean_text, fields_of, flat, lean, others, table, tune

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
PEM_END = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
ASSIGN_LEAST, ACCESS_LEAST, STEP = 6, 20, 8
ORDER = ("assign", "access", "hex", "github", "npm", "jwt", "iban", "pem")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: The lengths of account numbers by country, as registered.
IBAN_LENGTH = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25}

KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "iban": tuple(c.lower() + d for c in IBAN_LENGTH for d in "0123456789"),
    "pem": ("-----begin ",),
}
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(48, 58), *range(97, 103)]] = True


def token_checksum(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of those after the prefix."""
    body, check = token.partition("_")[2][:-6], token[-6:]
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits == check


def iban_checksum(text: str) -> bool:
    if IBAN_LENGTH.get(text[:2]) != len(text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def jwt_header(text: str) -> bool:
    part = text.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


def _machine():
    import ahocorasick

    m = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            m.add_word(w, (kind, len(w)))
    m.make_automaton()
    return m


def _added(kind: str, text: str, at: int, pem_ends: list[tuple[int, int]]) -> tuple[int, int] | None:
    if kind == "pem":
        if not (m := PEM.match(text, at)):
            return None
        if not pem_ends:
            pem_ends += [*(e.span() for e in PEM_END.finditer(text)), (len(text) + 1, 0)]
        start, end = pem_ends[bisect.bisect_left(pem_ends, (m.end(), 0))]
        return (at, end) if start <= len(text) else None
    if at and (text[at - 1].isalnum() or kind == "jwt" and text[at - 1] in "_-"):
        return None
    m = {"github": GITHUB, "npm": NPM, "jwt": JWT, "iban": IBAN}[kind].match(text, at)
    if m and {"github": token_checksum, "npm": token_checksum, "jwt": jwt_header, "iban": iban_checksum}[kind](m[0]):
        return m.span()
    return None


def find(text: str, machine, hexes: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start and then by kind as listed; hexes: those of hex."""
    spans: list[tuple[str, int, int]] = [("hex", *h) for h in hexes]
    # bytes.lower() touches A-Z only, so places in the text stay what they are.
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    after, pem_ends = dict.fromkeys(ORDER, 0), []
    hits = sorted((end - n + 1, kind) for end, (kind, n) in machine.iter(low))
    for at, kind in hits:
        if at < after[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                after[kind] = m.end()
                if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                    spans.append((kind, at, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                after[kind] = m.end()
                if m.end() - at >= ACCESS_LEAST:
                    spans.append((kind, at, m.end()))
        elif found := _added(kind, text, at, pem_ends):
            after[kind] = found[1]
            spans.append((kind, *found))
    return sorted(spans, key=lambda s: (s[1], ORDER.index(s[0]), s[2]))


def hex_runs(data: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int]]]:
    """The long hexadecimal runs of each text, in code points. Between two samples that are not
    hexadecimal no run of 24 bytes has less than three that are."""
    sample = _IS_HEX[data[::STEP]]
    three = np.zeros(len(sample), bool)
    three[: max(0, len(sample) - 2)] = sample[:-2] & sample[1:-1] & sample[2:]
    before = np.concatenate([[0], np.cumsum(three)])
    low, high = np.minimum(-(-at[:-1] // STEP), len(sample)), np.minimum(-(-at[1:] // STEP), len(sample))
    out: list[list[tuple[int, int]]] = [[] for _ in low]
    for d in np.flatnonzero(before[high] > before[low]).tolist():
        own = np.concatenate([[False], sample[low[d] : high[d]], [False]])
        edges = np.flatnonzero(own[1:] != own[:-1])  # starts and ends of runs of samples, in turn
        a, b = int(at[d]), int(at[d + 1])
        raw, found = data[a:b].tobytes(), []
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if last - first >= 3:
                begin = max((int(low[d]) + first - 1) * STEP + 1, a) - a
                found += [m.span() for m in HEX.finditer(raw, begin, min((int(low[d]) + last) * STEP, b) - a)]
        if found and not raw.isascii():
            points = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) != 0x80)])
            found = [(int(points[x]), int(points[y])) for x, y in found]
        out[d] = found
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "spans array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """All columns of docs (with text), and spans."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine()
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            hexes = hex_runs(*flat(texts))
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t or "", machine, h)] for t, h in zip(texts.to_pylist(), hexes)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found, kind)], names=[*names, "spans"])

    names = others(docs.columns, "spans")
    return docs.mapInArrow(lean(run), f"{fields_of(docs, names)}, {SPANS}")


def _masked(text: str | None, spans: list[tuple[int, int]], mark: str) -> str | None:
    parts, last = [], 0
    for start, end in spans:
        if start > last or not parts and start == last == 0:
            parts += [text[last:start], mark]
        last = max(last, end)
    return "".join([*parts, text[last:]]) if parts else text


def cleaned(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """redact(scan(docs)) in one map, with found: whether the text had a span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine()
        for b in batches:
            texts = b.column("text")
            found = [[s[1:] for s in find(t or "", machine, h)] for t, h in zip(texts.to_pylist(), hex_runs(*flat(texts)))]
            text = pa.array([_masked(t, s, mark) for t, s in zip(texts.to_pylist(), found)], pa.string())
            columns = [text if n == "text" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(s) for s in found])], names=[*names, "found"])

    names = others(docs.columns, "found")
    return docs.mapInArrow(lean(run), f"{fields_of(docs, names)}, found boolean")


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``scan`` with every span of the text replaced; spans that overlap or touch
    are replaced as one. A text without spans stays as it is, null included."""
    names = [c for c in scanned.columns if c != "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans").to_pylist()
            out = [_masked(t, [(s["start"], s["end"]) for s in x or ()], mark) for t, x in zip(b.column("text").to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else b.column(n) for n in names], names=names)

    return scanned.mapInArrow(lean(run), fields_of(scanned, names))


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    found = scan(clean_text(table(spark, sf_dir, "documents")))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(text(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
