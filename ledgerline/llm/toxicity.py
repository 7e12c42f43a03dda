"""Toxicity by a weighted finite-state pattern grammar (operator 7).

Words go through a lexicon transducer to symbols with weights: insult stems (learned weights), harm
words (weight 1), intent, target, negation and reported speech (listed below). Small machines follow
one context each: negation for a few words, a target or a report until the clause ends, intent until
harm completes a threat. Their product is one deterministic weighted transducer: each of its
transitions names the context that the symbol's weight goes to (plain, negated, reported, threat) or
none, and its final states say whether what was plain is aimed at a target, before it or behind. The
lexicon composed with it reads a clause word by word, and gives the clause's weight in each context.
A document's score is a logistic function of its clauses' weights, not of isolated words.

Learned from labelled rows: the insult stems with their log-odds weights (a stem is a word
prefix of 4 to 12 letters, or a whole word of 4 or more, that toxic documents share and others lack,
extended as long as it loses no document),
and the coefficients of the contexts.

Scale: scoring is one map over the scan, without a shuffle. Learning takes at most ``TRAIN_ROWS``
labelled rows; all their stems are counted and tested in Spark, and only the stems that pass reach
the driver: each stands in ``LEAST_SHARE`` of the toxic rows or more, so they are at most
1 / ``LEAST_SHARE`` times the stems of an average toxic row. Context weights are a row each.

Defined cases: a word that matches several stems takes the weight of the shortest; stems that keep
equally many documents are taken by the alphabet, the last first; very long texts and clauses are
read whole; a null text is empty and gets the score of a text without matches; labels with a
null id or label teach nothing; without labels of both kinds the score is the share of label 1,
or 0.5 without labels; repeated rows are scored each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import clean_text, crc_mod, cut, fields_of, lean, others, table, tune
from ledgerline.llm.quality import sample_of, taught

#: Labelled rows of learning, and stems that a task counts before it hands them on.
TRAIN_ROWS, COUNTED = 20_000, 200_000
SHORTEST, LONGEST, LEAST_DOCS, LEAST_ODDS = 4, 12, 3, 3.0
LEAST_SHARE = 0.005
THRESHOLD = 0.7

#: Fixed word lists of the grammar, English, German, French and Spanish.
HARM = "kill hurt destroy stab shoot strangle töten umbringen verletzen erschießen tuer frapper détruire blesser matar herir destruir golpear".split()
INTENT = "will gonna going shall werde werden will vais allons voy vamos".split()
TARGET = "you your yours you're u du dich dein deine ihr tu toi ton ta vous votre tú eres usted ustedes".split()
NEGATION = "not no never isn't aren't don't nicht kein keine nie ne pas jamais non nunca jamás".split()
REPORT = "said says called calls wrote quoted claims reported sagte nannte schrieb dit disait écrit appelé dijo llamó escribió".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
ENDS = ".!?;:\n"
CLAUSE = re.compile(f"[{ENDS}]+")
OTHER, INSULT, HARMS, INTENDS, TARGETS, NEGATES, REPORTS = range(7)
CONTEXTS = ("plain", "targeted", "negated", "reported", "threat")


@dataclass(frozen=True)
class Machine:
    """A deterministic transducer: step[state][symbol] -> state; state 0 starts."""

    step: tuple[tuple[int, ...], ...]


def _machine(n: int, rule) -> Machine:
    return Machine(tuple(tuple(rule(s, x) for x in range(7)) for s in range(n)))


#: Negation holds for three words; a target or report stays; intent (1) then harm (2) is a threat.
NEGATED = _machine(4, lambda s, x: 3 if x == NEGATES else max(0, s - 1))
TARGETED = _machine(2, lambda s, x: 1 if x == TARGETS else s)
REPORTED = _machine(2, lambda s, x: 1 if x == REPORTS else s)
THREAT = _machine(3, lambda s, x: 2 if x == HARMS and s == 1 else 1 if x == INTENDS or s == 1 else 0)


@dataclass(frozen=True)
class Transducer:
    """A weighted transducer: step[state][symbol] -> state; emit[state][symbol] -> the context that
    the symbol's weight goes to, or -1; aimed[state]: whether plain weight leaves as targeted there."""

    step: list[list[int]]
    emit: list[list[int]]
    aimed: list[bool]


def compose(*machines: Machine) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """The product machine as a table, and the parts' states of each of its states."""
    states = list(itertools.product(*(range(len(m.step)) for m in machines)))
    number = {s: k for k, s in enumerate(states)}
    return [[number[tuple(m.step[q][x] for m, q in zip(machines, s))] for x in range(7)] for s in states], states


def _context(symbol: int, negated: int, reported: int, threat: int) -> int:
    """Where the weight of a symbol goes whose transition leads to these states."""
    if symbol == INSULT:
        return CONTEXTS.index("reported" if reported else "negated" if negated else "plain")
    return CONTEXTS.index("threat") if threat == 2 and not negated and not reported else -1


def grammar_of(negation: Machine, target: Machine, report: Machine, threat: Machine) -> Transducer:
    step, states = compose(negation, target, report, threat)
    emit = [[_context(x, states[row[x]][0], states[row[x]][2], states[row[x]][3]) for x in range(7)] for row in step]
    return Transducer(step, emit, [bool(s[1]) for s in states])


class Grammar:
    def __init__(self, stems: dict[str, float]):
        """stems: a prefix, or a whole word with "$" behind it, to its weight."""
        import ahocorasick

        self.stems = stems
        self.lengths = sorted({len(s) for s in stems if not s.endswith("$")})
        self.fixed = {w: x for x, words in ((HARMS, HARM), (INTENDS, INTENT), (TARGETS, TARGET), (NEGATES, NEGATION), (REPORTS, REPORT)) for w in words}
        self.machine = grammar_of(NEGATED, TARGETED, REPORTED, THREAT)
        self.anchors = ahocorasick.Automaton()
        for w in [*(s.rstrip("$") for s in stems), *HARM]:
            self.anchors.add_word(w, len(w))
        self.anchors.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        if (w := self.stems.get(word + "$")) is not None:
            return INSULT, w
        for n in self.lengths:
            if (w := self.stems.get(word[:n])) is not None and len(word) >= n:
                return INSULT, w
        symbol = self.fixed.get(word, OTHER)
        return symbol, float(symbol == HARMS)

    def clause(self, text: str) -> list[float]:
        """What one clause (lower case) matches in each context."""
        out, state = [0.0] * len(CONTEXTS), 0
        m = self.machine
        for x, weight in map(self.symbol, WORD.findall(text)):
            context, state = m.emit[state][x], m.step[state][x]
            if context >= 0:
                out[context] += weight
        if m.aimed[state]:
            out[:2] = 0.0, out[0]
        return out

    def document(self, text: str) -> tuple[list[float], list[str]]:
        """The sums over matched clauses, and those clauses."""
        low = text.lower()
        total, matched, upto = [0.0] * len(CONTEXTS), [], -1
        for end, n in self.anchors.iter(low):
            at = end - n + 1
            if at < upto or (at and low[at - 1].isalpha()):
                continue
            # Back to the end of the clause before, or of the one read last.
            start = max(low.rfind(c, max(upto, 0), at) for c in ENDS) + 1
            m = CLAUSE.search(low, end + 1)
            upto = m.start() if m else len(low)
            found = self.clause(low[start:upto])
            if any(found):
                matched.append(low[start:upto].strip())
                total = [a + b for a, b in zip(total, found)]
        return total, matched

    def sums(self, texts: pa.Array) -> np.ndarray:
        return np.array([self.document(t or "")[0] for t in texts.to_pylist()], float).reshape(-1, len(CONTEXTS))


def word_prefixes(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w + "$" for w in words if len(w) >= SHORTEST}


def _counts(rows: DataFrame) -> DataFrame:
    """(stem, pos, neg): in how many of the rows (text, y) with y = 1 and y = 0 each stem occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            stems = list(n[1].keys() | n[0].keys())
            return pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *(pa.array([n[y][s] for s in stems], pa.int64()) for y in (1, 0))], names=["stem", "pos", "neg"])

        for b in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[y].update(word_prefixes(t or ""))
                if len(n[0]) + len(n[1]) >= COUNTED:
                    yield counted()
                    n = (Counter(), Counter())
            yield counted()

    return rows.select("text", "y").mapInArrow(lean(run), "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _odds(pos, neg, n_pos: int, n_neg: int, log):
    return log((pos + 0.5) / (n_pos + 1)) - log((neg + 0.5) / (n_neg + 1))


def good_stems(counts: DataFrame, n_pos: int, n_neg: int, candidates: int) -> DataFrame:
    """The rows of counts (stem, pos, neg) whose stem teaches something; candidates: how many were tried."""
    # A stem that stands in so few documents, all of them toxic, that chance among so many
    # candidates would do as much, teaches nothing.
    chance = float(np.log(0.1 / max(1, candidates)) / np.log(n_pos / (n_pos + n_neg)))
    pos, neg = F.col("pos"), F.col("neg")
    return counts.where((pos >= max(LEAST_DOCS, LEAST_SHARE * n_pos, chance)) & (_odds(pos, neg, n_pos, n_neg, F.log) >= LEAST_ODDS) & (neg <= 0.02 * pos * n_neg / max(1, n_pos)))


def choose_stems(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int) -> dict[str, float]:
    """Log-odds of the good stems, each extended while it keeps nearly all of its documents."""
    chosen: dict[str, float] = {}
    longer: dict[str, list[str]] = {}
    for s in pos:
        if len(s) > SHORTEST:
            longer.setdefault(s[:-1], []).append(s)
    for s in sorted(pos, key=lambda s: (len(s), s)):
        if s[:-1] in pos:
            continue  # reached from its shorter form
        while kin := [t for t in longer.get(s, ()) if pos[t] >= 0.95 * pos[s]]:
            s = max(kin, key=lambda t: (pos[t], t))
        chosen[s] = float(_odds(pos[s], neg.get(s, 0), n_pos, n_neg, np.log))
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Ridge logistic coefficients, the constant last; coefficients of matches stay >= 0."""
    a = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], 0.05), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(ridge)
        w = w + np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


@dataclass
class Model:
    stems: dict[str, float]
    weights: np.ndarray

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log1p(sums) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, learn, rows: int = TRAIN_ROWS) -> Model:
    spark = docs.sparkSession
    sample = cut(spark, sample_of(docs, labels, "toxic", learn, rows))  # read three times
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    share = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.5
    prior = np.append(np.zeros(len(CONTEXTS)), np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if not n_pos or not n_neg:
        return Model({}, prior)
    tried = cut(spark, _counts(sample).where(F.col("pos") >= LEAST_DOCS))
    good = good_stems(tried, n_pos, n_neg, tried.count()).collect()
    stems = choose_stems({r.stem: r.pos for r in good}, {r.stem: r.neg for r in good}, n_pos, n_neg)
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("pick", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for b in batches:
            x = pa.array(list(grammar.sums(b.column("text"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "y", "pick")), x], schema=schema)

    got = taught(sample.mapInArrow(lean(run), "doc_id long, y int, pick long, x array<double>"), rows)
    return Model(stems, _logistic(np.log1p(np.array([r.x for r in got]).reshape(-1, len(CONTEXTS))), np.array([r.y for r in got], float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs (with text), score, and clauses: what matched, lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.stems)
        for b in batches:
            found = [grammar.document(t or "") for t in b.column("text").to_pylist()]
            sums = np.array([f[0] for f in found], float).reshape(-1, len(CONTEXTS))
            made = [pa.array(model.score(sums)), pa.array([f[1] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *made], names=[*names, "score", "clauses"])

    names = others(docs.columns, "score", "clauses")
    return docs.mapInArrow(lean(run), f"{fields_of(docs, names)}, score double, clauses array<string>")


def held_out():
    return crc_mod("doc_id", 3) == 1


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = clean_text(table(spark, sf_dir, "documents"))
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("clauses").cast("long").alias("n_clauses"))
