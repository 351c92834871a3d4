"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers read a clause's tokens from left to right. A token is a symbol: the set of word classes that it is of. Taggers
come one after the other: what stands behind a negation, a verb of speech, a target or an object is marked as such, as far as each reaches.
Two matchers read the marked symbols: one writes an insult where an abusive term stands, plain or aimed at a target before or behind
it; the other writes a threat where a threatening word and a target meet. The cascade of all is composed into one machine. What it writes has a
weight: that of the term and of its target, or that of a threat, of which a negation or a report leaves a small part. A text's score
comes from the weights of its matched clauses, not from its words.

Weights of abusive terms are learnt from labelled documents: words, and the beginnings of words for languages that join words or
inflect, by their log odds among toxic ones. One half of the sample gives the terms, the other how the clauses' weights make a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import pieces

#: Labelled documents of each label from which the grammar is learnt, about.
FIT_DOCS = 3000
#: A term stands in so many toxic documents of the sample at least, has so many nats of log odds, and stands under such a share of the clean.
LEAST_DOCS, LEAST_ODDS = 5, 2.5
#: Lengths of beginnings of words that are terms.
STEMS = range(4, 9)
CLAUSE = re.compile(r"[.,;:!?\n|()\"»«]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
# Closed word classes of English, German, Spanish and French, of our own choice.
WORDS = {
    "target": "you your yours yourself they them he him she her du dich dir dein deine ihr euch sie tú tu te ti usted ustedes vosotros él ella ellos toi ton ta tes vous votre il elle ils elles",
    "negation": "not never isn't aren't wasn't don't doesn't won't cannot can't nicht kein keine keinen nie nunca jamás tampoco pas jamais aucun aucune",
    "report": "said says saying called calls wrote writes claimed quoted sagte sagt nannte schrieb dijo dice llamó escribió dit disait appelé écrit",
    "object": "dich dir euch te ti toi vous",
    "threat": "kill hurt destroy murder beat burn crush töten umbringen verletzen matar golpear destruir tuer frapper détruire",
}
#: The classes of a symbol, and what the taggers mark it with.
TARGET, NEGATION, REPORT, OBJECT, THREAT, INSULT, AIMED, FACED, NEGATED, REPORTED = (1 << i for i in range(10))
CLASSES = {"target": TARGET, "negation": NEGATION, "report": REPORT, "object": OBJECT, "threat": THREAT}
#: Tokens behind a word to which it reaches, and behind an insult or a threat where its target may stand.
REACH = {TARGET: 6, NEGATION: 4, REPORT: 8, OBJECT: 3, INSULT: 2, THREAT: 4}
#: Nats that a target adds to an insult, and those of a threat with a target; what a negation and a report leave of either.
AIM, MENACE, UNDER_NEGATION, UNDER_REPORT = 1.0, 8.0, 0.05, 0.25
COUNTS = "term string, half int, toxic long, clean long"

State = tuple
#: (state, symbol) to (next state, what is written).
Step = Callable[[State, int], tuple[State, object]]


def tagger(opens: int, mark: int) -> Step:
    """Marks the symbols up to REACH[opens] behind one of the class `opens`; its state is how far it still reaches."""

    def step(state: State, symbol: int) -> tuple[State, int]:
        (left,) = state
        written = symbol | mark if left else symbol
        return (REACH[opens] if symbol & opens else max(0, left - 1),), written

    return step


def matcher(kind: int, mark: int) -> Step:
    """Writes (event, kind, negated, reported) where a word of `kind` stands and where a target meets it: one before it, by its mark, or behind.

    Its state is how far behind the last such word, not aimed yet, a target may stand, and that word's marks.
    """

    def step(state: State, symbol: int) -> tuple[State, tuple]:
        left, marks = state
        written: tuple = ()
        if left and symbol & TARGET:
            written += (("met", kind, bool(marks & NEGATED), bool(marks & REPORTED)),)
            left, marks = 0, 0
        if symbol & kind:
            written += (("word", kind, bool(symbol & NEGATED), bool(symbol & REPORTED)),)
            if symbol & mark:
                written += (("met", kind, bool(symbol & NEGATED), bool(symbol & REPORTED)),)
                return (0, 0), written
            return (REACH[kind], symbol & (NEGATED | REPORTED)), written
        return (left - 1, marks) if left > 1 else (0, 0), written

    return step


def in_turn(first: Step, second: Step, width: int) -> Step:
    """The composition: what the first writes is what the second reads. Its state is theirs, of which `width` parts are the first's; arcs are made when they are first taken."""

    @cache
    def step(state: State, symbol: int) -> tuple[State, object]:
        one, between = first(state[:width], symbol)
        two, written = second(state[width:], between)
        return one + two, written

    return step


def side_by_side(first: Step, second: Step, width: int) -> Step:
    """Both read the same, and write one after the other."""

    @cache
    def step(state: State, symbol: int) -> tuple[State, tuple]:
        (one, a), (two, b) = first(state[:width], symbol), second(state[width:], symbol)
        return one + two, a + b

    return step


#: A target before an insult aims it; before a threat only one that is an object does.
TAGGERS = (tagger(NEGATION, NEGATED), tagger(REPORT, REPORTED), tagger(TARGET, AIMED), tagger(OBJECT, FACED))
MATCHERS = (matcher(INSULT, AIMED), matcher(THREAT, FACED))
MACHINE = in_turn(in_turn(in_turn(in_turn(TAGGERS[0], TAGGERS[1], 1), TAGGERS[2], 2), TAGGERS[3], 3), side_by_side(*MATCHERS, 2), 4)
START: State = (0,) * 8


def left_of(negated: bool, reported: bool) -> float:
    return (UNDER_NEGATION if negated else 1.0) * (UNDER_REPORT if reported else 1.0)


def clause_weight(symbols: list[int], weights: list[float], step: Step = MACHINE, start: State = START) -> float:
    """The weight of what the machine writes over a clause: an insult its term's and AIM if it meets a target, a threat MENACE where it meets one."""
    state, total = start, 0.0
    for symbol, w in zip(symbols, weights):
        state, written = step(state, symbol)
        for event, kind, negated, reported in written:
            gain = (w if event == "word" else AIM) if kind == INSULT else (MENACE if event == "met" else 0.0)
            total += gain * left_of(negated, reported)
    return total


def stems(token: str) -> Iterator[str]:
    yield token
    for n in STEMS:
        if n < len(token):
            yield token[:n] + "*"


@dataclass
class Grammar:
    weights: dict[str, float]
    bias: float = -2.0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(3))
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def look(self, token: str) -> tuple[int, float]:
        """A token's symbol, and its weight if it is an abusive term: that of the word, else of its longest beginning that is a term."""
        w = self.weights.get(token, 0.0)
        if not w:
            for n in range(min(len(token) - 1, STEMS[-1]), STEMS[0] - 1, -1):
                if w := self.weights.get(token[:n] + "*", 0.0):
                    break
        found = (INSULT if w else 0) | sum(bit for name, bit in CLASSES.items() if token in OWN[name]), w
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[token] = found
        return found

    def features(self, text: str) -> np.ndarray:
        """The logarithms of the weight of all matched clauses and of the heaviest, and the share of clauses that matched. A text without a word has zeros."""
        total = most = 0.0
        clauses = matched = 0
        get, look = self.known.get, self.look
        for clause in CLAUSE.split(text.lower()):
            tokens = TOKEN.findall(clause)
            if not tokens:
                continue
            clauses += 1
            found = [get(t) or look(t) for t in tokens]
            # Without a term or a threat the machine writes nothing.
            if not any(f[0] & (INSULT | THREAT) for f in found):
                continue
            w = clause_weight([f[0] for f in found], [f[1] for f in found])
            if w:
                matched += 1
                total += w
                most = max(most, w)
        return np.array([math.log1p(total), math.log1p(most), matched / clauses if clauses else 0.0])

    def score(self, features: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(features @ self.coefficients) + self.bias))))


OWN = {name: frozenset(said.split()) for name, said in WORDS.items()}


def rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """logistic() with no coefficient below 0: more matched weight never lowers a score."""
    use = np.arange(x.shape[1])
    while True:
        w = logistic(x[:, use], y)
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[use], out[-1] = w[:-1], w[-1]
            return out
        use = np.delete(use, int(w[:-1].argmin()))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients and, last, the bias, by Newton's method with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    hold = ridge * np.eye(x.shape[1])
    hold[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + hold / len(x) * 10 + 1e-9 * np.eye(x.shape[1]), x.T @ (p - y) / len(x) + hold @ w / len(x) * 10)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by = {(h, t): Counter() for h in (0, 1) for t in (0, 1)}
    for batch in pieces(batches, "text"):
        for text, half, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "half", "toxic"))):
            by[half, toxic].update({s for token in set(TOKEN.findall((text or "").lower())) for s in stems(token)})
            by[half, toxic][""] += 1
    for half in (0, 1):
        terms = sorted(by[half, 0].keys() | by[half, 1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([half] * len(terms), pa.int32()), pa.array([by[half, 1][t] for t in terms], pa.int64()), pa.array([by[half, 0][t] for t in terms], pa.int64())],
            names=["term", "half", "toxic", "clean"],
        )


def learn(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Grammar:
    """The grammar of labels (doc_id, toxic 0/1) of docs (doc_id, text).

    About fit_docs documents of each label, chosen by a hash of doc_id over all rows, are counted on the
    executors. Only terms that LEAST_DOCS of them bear out and one row of features a document reach the
    driver. Without both labels the grammar knows no term and scores everything alike.
    """
    own = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").distinct()
    sizes = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Grammar({})
    share = F.when(F.col("toxic") == 1, min(1.0, fit_docs / sizes[1])).otherwise(min(1.0, fit_docs / sizes[0]))
    draw = F.pmod(F.xxhash64(F.lit(41), "l_id"), F.lit(1_000_000))
    chosen = own.where(draw < share * 1_000_000).select("l_id", "toxic", (F.pmod(F.xxhash64(F.lit(43), "l_id"), F.lit(2))).cast("int").alias("half"))
    # The sample's ids are bounded by fit_docs: its texts are picked out where they are read.
    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("text", "toxic", "half")
    counted = drawn.mapInArrow(counts, COUNTS).groupBy("term", "half").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # The second half learns from the first's terms; the final terms are of both.
    seen: dict[int, dict[str, tuple[int, int]]] = {0: {}, 1: {}, 2: {}}
    both = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).select("term", F.lit(2).alias("half"), "toxic", "clean")
    for r in counted.union(both).where(f"term = '' or (toxic >= {LEAST_DOCS} and toxic > clean * {math.exp(LEAST_ODDS) * 0.5} * {sizes[1]} / {sizes[0]} * {min(1.0, fit_docs / sizes[1])} / {min(1.0, fit_docs / sizes[0])})").toLocalIterator():
        seen[r.half][r.term] = (r.toxic, r.clean)

    def grammar(half: int) -> Grammar:
        toxic, clean = seen[half].pop("", (0, 0))
        odds = {t: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) for t, (a, b) in seen[half].items()}
        return Grammar({t: w for t, w in odds.items() if w >= LEAST_ODDS})

    parts = [grammar(0), grammar(1)]
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = [shared.value[1 - half].features(text or "") for text, half in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    found = drawn.mapInArrow(measured, "x array<double>, toxic int").toArrow()
    final = grammar(2)
    if found.num_rows:
        w = rising(np.array(found.column("x").to_pylist()), found.column("toxic").to_numpy().astype(float))
        final.coefficients, final.bias = w[:-1], float(w[-1]) - math.log(max(1, min(fit_docs, sizes[1])) / max(1, min(fit_docs, sizes[0]))) + math.log(sizes[1] / sizes[0])
    return final


def scored(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score) for every row of docs (doc_id, text): from 0 to 1, higher for the likelier toxic. Null and empty texts match nothing; repeated rows are scored one by one; a text is read clause by clause, whole. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in pieces(batches, "text"):
            out = [known.score(known.features(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
