"""Personal data by weak supervision (operator 11).

Candidate spans come from expressions, the base's and looser ones. Eight labelers, none of which is
right always, vote on each: shape, checksum or range, a gazetteer of what such data are made of, one of
reserved values, words before that tell of the kind, words before that tell of something else, how
the span stands between its neighbours, and how many of its kind the text has. Expectation-maximisation
finds each labeler's reliability by kind (what it votes of true spans and of others) from how the votes
agree. The posteriors are the soft labels of a logistic classifier over a span's form and its
neighbouring words, which decides.

Base kinds, in order: ``email``, ``ip``, ``card``, ``phone``. They stay whatever the classifier says;
matches that fail the base's tests are candidates that the reliabilities are learned from, and are never
given. The method adds ``spelled_email``, ``local_phone``, ``ssn``, ``iban``, ``name`` and ``street``,
where the classifier's probability is ACCEPT or more and no base span covers them. Spans are code points,
end exclusive.

Scale: one map over the texts gives candidates without the texts, written once; the votes are counted by
pattern over all of them (at most kinds * 3**8 rows, whatever the input), and the classifier is fitted to
at most QUOTA candidates of a kind, those of least hash (SAMPLE in all). No expression reads a place more
often than a bounded number of times, so the longest text takes time in proportion to its length.

Defined cases: a null text is empty and has no spans; a null doc_id is kept; spans that start together are
in the order of kinds as listed; repeated rows are scanned each; an empty table gives no rows; a table
without candidates adds no span; further columns are kept by ``find``, but for ``found``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import clean_text, cut, fields_of, lean, others, table, tune
from ledgerline.llm.secrets import IBAN_LENGTH, iban_checksum

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "spelled_email", "local_phone", "ssn", "iban", "name", "street")
PLACE = {k: i for i, k in enumerate(KINDS)}
LABELERS = ("shape", "checksum", "gazetteer", "reserved", "cue", "counter_cue", "neighbours", "crowd")
ABSTAIN, YES, NO = 0, 1, 2
#: Candidates that the classifier is fitted to at most: of a kind, and of all.
QUOTA, SAMPLE = 4_000, 40_000
ACCEPT = 0.5
BUCKETS = 1 << 12
#: Of a text's candidates of one kind, more than these are a listing.
CROWD = 20

# The base's expressions. Runs that no shorter or later match can begin in are read once.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]\x20?(?:dot|DOT)\x20?[\])])\x20?[A-Za-z0-9-]{1,63}){1,4}")
LOCAL_PHONE = re.compile(r"(?<![0-9+(./-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9./-])")
SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame")
GIVEN = ("James", "Mary", "John", "Anna", "Peter", "Maria", "Thomas", "Julia", "Michael", "Laura", "Pierre", "Camille", "Hans", "Greta", "Carlos", "Lucia", "David", "Sarah", "Paul", "Emma")
NAME = re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\.?\x20|(?:{'|'.join(GIVEN)})\x20)[A-ZÀ-Þ][\w'-]{{1,40}}(?:\x20[A-ZÀ-Þ][\w'-]{{1,40}})?")
STREET = re.compile(r"\b[0-9]{1,5}\x20(?:[A-Z][a-z]{1,30}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Boulevard)\b|\b[A-ZÄÖÜ][a-zäöüß]{1,40}(?:straße|strasse|weg|platz)\x20[0-9]{1,4}\b")
LOOSE = {"spelled_email": SPELLED, "local_phone": LOCAL_PHONE, "ssn": SSN, "iban": IBAN, "name": NAME, "street": STREET}

TOP_LEVEL = frozenset("com org net edu gov io info biz de fr es uk it nl be at ch pt eu us ca au".split())
DIALING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91", "351", "353", "358")
ISSUERS = ("4", "34", "37", "51", "52", "53", "54", "55", "6011", "65")
CUES = {
    "email": ("mail", "email", "contact", "write", "kontakt", "correo", "courriel"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "teléfono", "téléphone", "whatsapp"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "tarjeta", "carte"),
    "ip": ("ip", "host", "client", "server", "login", "address", "peer"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "name": ("name", "dear", "signed", "contact", "sincerely", "by", "liebe", "lieber", "chère", "cher", "querido"),
    "street": ("address", "live", "lives", "at", "adresse", "anschrift", "dirección", "domicile"),
}
CUES |= {"spelled_email": CUES["email"], "local_phone": CUES["phone"]}
COUNTER = ("version", "build", "isbn", "order", "sku", "serial", "commit", "release", "section", "figure", "doi", "v", "chapter", "page")
WORDS = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    """Whether a number of any length is at most 255."""
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Every match begins where the run of characters before an @ does, or where the last match ended."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1  # no later match holds this @
        at = text.find("@", last)
    return out


def base_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it passes the kind's test) of the base's expressions."""
    out = [("email", a, b, True) for a, b in emails(text)]
    out += [("ip", *m.span(), all(map(_small, m[0].split(".")))) for m in IP.finditer(text)]
    for m in CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19:
            out.append(("card", *m.span(), luhn(d)))
    out += [("phone", *m.span(), 9 <= len(_digits(m[0])) <= 15) for m in PHONE.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """base_matches, and looser ones that no passing base match covers; by start and kind."""
    out = base_matches(text)
    held = sorted((a, b) for _, a, b, ok in out if ok)
    for kind, expression in LOOSE.items():
        k = 0
        for m in expression.finditer(text):
            a, b = m.span()
            while k < len(held) and held[k][1] < b:
                k += 1
            if not (k < len(held) and held[k][0] <= a):
                out.append((kind, a, b, False))
    return sorted(out, key=lambda c: (c[1], PLACE[c[0]], c[2]))


def _shape(kind: str, s: str) -> int:
    if kind == "email":
        local = s.partition("@")[0]
        return NO if ".." in s or local[0] == "." or local[-1] == "." or not s.rpartition(".")[2].isalpha() else YES
    if kind == "ip":
        return NO if any(len(p) > 1 and p[0] == "0" for p in s.split(".")) else YES
    if kind == "card":
        return YES if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2}", s) else NO
    if kind in ("phone", "local_phone"):
        return YES if s.count("(") == s.count(")") <= 1 and not re.search(r"[ .-]{2}|\.\(|\)\)", s) else NO
    return YES if kind in ("ssn", "spelled_email", "street") else ABSTAIN


def _checksum(kind: str, s: str) -> int:
    d = _digits(s)
    if kind == "card":
        return YES if luhn(d) else NO
    if kind == "ip":
        return YES if all(map(_small, s.split("."))) else NO
    if kind == "phone":
        return YES if 9 <= len(d) <= 15 else NO
    if kind == "local_phone":
        return YES if 9 <= len(d) <= 11 else NO
    if kind == "ssn":
        return NO if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else YES
    if kind == "iban":
        return YES if iban_checksum(s.replace(" ", "")) else NO
    return ABSTAIN


def _gazetteer(kind: str, s: str) -> int:
    if kind in ("email", "spelled_email"):
        return YES if s.lower().rpartition(".")[2].strip(" )]") in TOP_LEVEL else NO
    if kind == "phone":
        return YES if _digits(s).startswith(DIALING) else NO
    if kind == "card":
        return YES if _digits(s).startswith(ISSUERS) else NO
    if kind == "iban":
        return YES if s[:2] in IBAN_LENGTH else NO
    if kind == "name":
        words = s.replace(".", "").split(" ")
        return YES if any(w in GIVEN for w in words) else ABSTAIN
    return ABSTAIN


def _reserved(kind: str, s: str) -> int:
    if kind == "ip":
        a, b = (p.lstrip("0")[:4] or "0" for p in s.split(".")[:2])
        return NO if a in ("0", "10", "127", "255") or (a, b) == ("192", "168") or a == "172" and len(b) == 2 and 16 <= int(b) <= 31 else ABSTAIN
    if kind in ("card", "ssn", "phone", "local_phone"):
        return NO if len(set(_digits(s))) <= 2 else ABSTAIN
    return ABSTAIN


def _before(text: str, at: int) -> list[str]:
    return [w.lower() for w in WORDS.findall(text[max(0, at - 40) : at])[-3:]]


def votes(text: str, kind: str, a: int, b: int, same: int) -> tuple[int, ...]:
    """One vote of each labeler on a candidate of a text that has ``same`` of its kind."""
    s, words = text[a:b], _before(text, a)
    left, right = text[a - 1 : a], text[b : b + 1]
    glued = left.isalnum() or right.isalnum() or left in "=/_#@\\" and left != "" or right in "=/_@\\" and right != ""
    return (
        _shape(kind, s), _checksum(kind, s), _gazetteer(kind, s), _reserved(kind, s),
        YES if any(w in CUES[kind] for w in words) else ABSTAIN, NO if any(w in COUNTER for w in words) else ABSTAIN,
        NO if glued else YES, NO if same > CROWD else ABSTAIN,
    )


def _class(c: str) -> str:
    return "none" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c if c in ".,:;()[]<>\"'=/-" else "other"


def features(text: str, kind: str, a: int, b: int) -> list[int]:
    """Buckets of what a span looks like and stands beside, by kind."""
    s, d = text[a:b], sum("0" <= c <= "9" for c in text[a:b])
    after = WORDS.findall(text[b : b + 20])[:1]
    told = [f"size {min(40, b - a) // 4}", f"digits {min(d, 20)}", f"marks {min(8, sum(not c.isalnum() for c in s))}", f"left {_class(text[a - 1 : a])}", f"right {_class(text[b : b + 1])}", f"first {s[:1].lower()}", f"capital {s[:1].isupper()}", f"line {a == 0 or text[a - 1] == chr(10)}"]
    told += [f"word {w}" for w in _before(text, a)] + [f"next {w.lower()}" for w in after]
    return sorted({zlib.crc32(f"{kind} {t}".encode("utf-8", "surrogatepass")) % BUCKETS for t in [*told, ""]})


FOUND = "found array<struct<kind:string,start:long,end:long,base:boolean,votes:int,features:array<int>>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]))


def candidates_of(text: str) -> list[dict]:
    found = candidates(text)
    same: dict[str, int] = {}
    for kind, *_ in found:
        same[kind] = same.get(kind, 0) + 1
    out = []
    for kind, a, b, base in found:
        packed = 0
        for v in votes(text, kind, a, b, same[kind]):
            packed = 3 * packed + v
        out.append({"kind": kind, "start": a, "end": b, "base": base, "votes": packed, "features": features(text, kind, a, b)})
    return out


def find(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """All columns of docs (without the text, if asked) and the candidates in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [candidates_of(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found, _FOUND)], names=[*names, "found"])

    names = others(docs.columns, "found", *(() if keep_text else ("text",)))
    return docs.mapInArrow(lean(run), ", ".join(filter(None, (fields_of(docs, names), FOUND))))


def reliabilities(patterns: list[tuple[str, int, int]], rounds: int = 100) -> tuple[dict[tuple[str, int], float], dict[str, np.ndarray]]:
    """Of (kind, packed votes, count): the posterior of each pattern, and by kind what labelers vote
    of true spans (0) and of others (1), an array [true or not, labeler, vote]. Where a kind has few
    candidates, the prior belief that labelers are better than chance prevails."""
    posterior, learned = {}, {}
    prior = np.array([[0.4, 0.5, 0.1], [0.4, 0.1, 0.5]])[:, None, :].repeat(len(LABELERS), axis=1)
    for kind in KINDS:
        own = [(v, n) for k, v, n in patterns if k == kind]
        if not own:
            continue
        packed, count = np.array([v for v, _ in own]), np.array([n for _, n in own], float)
        vote = packed[:, None] // 3 ** np.arange(len(LABELERS))[::-1] % 3
        one_hot = (vote[:, :, None] == np.arange(3)).astype(float)
        share, theta = 0.5, prior.copy()
        for _ in range(rounds):
            log = np.einsum("plv,ylv->py", one_hot, np.log(theta)) + np.log([share, 1 - share])
            true = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -500, 500)))
            weight = np.stack([true, 1 - true], axis=1) * count[:, None]
            theta = np.einsum("plv,py->ylv", one_hot, weight) + 5 * prior
            theta /= theta.sum(axis=2, keepdims=True)
            share = float((weight[:, 0].sum() + 1) / (count.sum() + 2))
        learned[kind] = theta
        posterior.update({(kind, int(v)): float(t) for v, t in zip(packed, true)})
    return posterior, learned


def logistic(rows: list[list[int]], labels: np.ndarray, rounds: int = 200, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on rows of buckets with soft labels. Steps are bounded by the
    curvature's diagonal majorant, so each round improves the fit."""
    weights = np.zeros(BUCKETS)
    if not rows:
        return weights
    size = np.array([len(r) for r in rows])
    row, bucket = np.repeat(np.arange(len(rows)), size), np.concatenate([np.asarray(r, np.int64) for r in rows])
    bend = 0.25 * np.bincount(bucket, size[row], BUCKETS) + ridge
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[bucket], len(rows)), -500, 500)))
        weights -= (np.bincount(bucket, (p - labels)[row], BUCKETS) + ridge * weights) / bend
    return weights


def fit(found: DataFrame, quota: int = QUOTA, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights. found (doc_id, found) is read twice: cut it before."""
    each = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    patterns = [(r.kind, r.votes, r.n) for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()]
    posterior, _ = reliabilities(patterns)
    total: dict[str, int] = {}
    for kind, _, n in patterns:
        total[kind] = total.get(kind, 0) + n
    if not total:
        return np.zeros(BUCKETS)
    draw = F.xxhash64("doc_id", "start", "kind")
    rate = F.create_map(*(x for k, n in total.items() for x in (F.lit(k), F.lit(min(1.0, quota / n)))))
    drawn = each.withColumn("draw", draw).where(F.pmod("draw", F.lit(1_000_000)) < rate[F.col("kind")] * 1_000_000)
    rows = drawn.orderBy("draw", "kind", "votes", "features").limit(sample).select("kind", "votes", "features").collect()
    return logistic([r.features for r in rows], np.array([posterior[r.kind, r.votes] for r in rows]))


SPANS = "spans array<struct<kind:string,start:long,end:long,base:boolean,probability:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))


def decide(found: DataFrame, weights: np.ndarray, accept: float = ACCEPT) -> DataFrame:
    """The spans among the candidates: the base's, and those added that the classifier accepts."""
    names = others(found.columns, "found", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.column("found").to_pylist():
                kept = []
                for c in row or ():
                    p = float(1 / (1 + np.exp(-np.clip(weights[c["features"]].sum(), -500, 500))))
                    if c["base"] or c["kind"] not in BASE and p >= accept:
                        kept.append({"kind": c["kind"], "start": c["start"], "end": c["end"], "base": c["base"], "probability": p})
                out.append(kept)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, _SPANS)], names=[*names, "spans"])

    return found.mapInArrow(run, ", ".join(filter(None, (fields_of(found, names), SPANS))))


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    found = cut(spark, find(clean_text(table(spark, sf_dir, "documents")), keep_text=False))
    spans = decide(found, fit(found))
    text = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
