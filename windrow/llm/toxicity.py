"""Toxicity as a weighted finite-state pattern grammar over clauses.

A lexicon transducer reads every word letter by letter (a whole word first, then the longest entry that is a prefix of the
word, so inflected forms are read by their stem) and gives its class: an insult of some strength, a threat, a target, a
negation, a reporting verb. Five small transducers over these classes - negation and report with their scope in words,
target, insult, threat - are composed into one machine. Their arcs carry marks, and composing adds them up: an insult in
the scope of a negation is marked as insult and as negated. Every mark has a weight, so every arc of the composed machine
has one: its marks' sum, or nothing if a negation or a report cancels it. A clause (a stretch of words between stops, or a
table cell) weighs what its path's arcs weigh, the heaviest in full and each further one a smaller share (a half, a third
...); a document weighs what its clauses weigh, added up in the same way. Its score is the logistic function of that.

Fixed function words give targets, negations, threats and reporting verbs. The insult entries with their strengths are
learnt from labelled documents, and so are the weights, which are held near priors: labelled documents have next to no
threats, negated or reported insults to learn from, and a grammar that waited for them would read isolated words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Hashable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import islice, takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import batches, held_out, materialised, release, strings, table, training_sample

#: Bound on the labelled rows that lexicon and weights are fitted on.
TRAINING_ROWS = 16_384
REMEMBERED = 60_000
#: Letters of the shortest entry, and of the longest stem; whole words may be longer.
SHORTEST, LONGEST = 3, 40

# Function words of the grammar's closed classes, in the corpus's four languages.
TARGETS = "you your yours yourself he him she her they them their we us people everyone tu toi vous votre ils elles eux du dich dir ihr euch sie ihnen usted ustedes vosotros ellos ellas te".split()
NEGATIONS = "not no never nobody none neither nor cannot isn't aren't wasn't don't doesn't didn't won't pas jamais aucun ni nicht kein keine keinen nie niemals nunca tampoco jamás".split()
THREATS = "kill hurt destroy burn hunt shoot stab beat crush tuer frapper détruire brûler töten schlagen zerstören verbrennen matar golpear destruir quemar".split()
REPORTING = "said says say told tells wrote writes claimed claims reported quoted alleged called dit disait déclaré écrit sagte sagt schrieb behauptet dijo dice escribió afirmó".split()

OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT = range(6)  # INSULT + strength for an insult of that strength
STRENGTHS = 3
CLASSES = INSULT + STRENGTHS
STOP = -1
#: What arcs are marked with: insults by strength, their target, negation and report, and threats at a target.
MARKS = ("weak insult", "insult", "strong insult", "at target", "negated", "reported", "threat")
#: Where the weights of marks lie without evidence, how strongly they are held there, and their bounds: a target raises
#: an arc's weight, a negation cancels even a strong insult, a report takes most of it, and a threat is toxic by itself.
PRIOR = (0.0, 0.0, 0.0, 1.0, -8.0, -4.0, 7.0)
HELD = (0.05, 0.05, 0.05, 10.0, 10.0, 10.0, 10.0)
BOUNDS = ((-9.0, 12.0), (0.0, 12.0), (0.0, 12.0), (0.0, 6.0), (-20.0, -6.0), (-12.0, -2.0), (4.0, 12.0))
#: Words that a negation or a report reaches over.
SCOPE = 4

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:|\n]+")


@dataclass(frozen=True)
class Machine:
    """A deterministic transducer: arcs[state, symbol] is (next state, output symbol, marks). It starts in `start`."""

    start: Hashable
    arcs: dict[tuple, tuple]

    def run(self, symbols: Iterable) -> tuple[list, list[str]]:
        """(output symbols, marks of the path)."""
        state, out, marks = self.start, [], []
        for x in symbols:
            state, y, m = self.arcs[state, x]
            out.append(y)
            marks += m
        return out, marks


def compose(a: Machine, b: Machine) -> Machine:
    """The machine that reads what a reads, writes what b writes of a's output, and marks its path as both do."""
    start = a.start, b.start
    arcs, waiting, known = {}, [start], {start}
    outgoing: dict = {}
    for (state, x), arc in a.arcs.items():
        outgoing.setdefault(state, []).append((x, arc))
    while waiting:
        p, q = waiting.pop()
        for x, (p_next, y, marks) in outgoing.get(p, ()):
            if (q, y) not in b.arcs:
                continue
            q_next, z, more = b.arcs[q, y]
            arcs[(p, q), x] = (p_next, q_next), z, marks + more
            if (p_next, q_next) not in known:
                known.add((p_next, q_next))
                waiting.append((p_next, q_next))
    return Machine(start, arcs)


def scope(opener: int, symbols: list[tuple]) -> Machine:
    """Adds to every symbol whether it stands within SCOPE words after one of the class `opener`."""
    return Machine(0, {(left, x): (SCOPE if x[0] == opener else max(0, left - 1), (*x, left > 0), ()) for left in range(SCOPE + 1) for x in symbols})


def target(symbols: list[tuple]) -> Machine:
    """Adds whether a target stood before in the clause."""
    return Machine(False, {(seen, x): (seen or x[0] == TARGET, (*x, seen), ()) for seen in (False, True) for x in symbols})


def spoken(x: tuple) -> tuple[str, ...]:
    """The marks of how a word is said."""
    _, negated, reported, _ = x
    return ("negated",) * negated + ("reported",) * reported


def insult(symbols: list[tuple]) -> Machine:
    """Marks insults; one without a target waits for it."""
    arcs = {}
    for waits in (False, True):
        for x in symbols:
            kind, _, _, at = x
            if kind >= INSULT:
                arcs[waits, x] = not at, x, (MARKS[kind - INSULT], *("at target",) * at, *spoken(x))
            else:
                arcs[waits, x] = waits and kind != TARGET, x, ("at target",) if waits and kind == TARGET else ()
    return Machine(False, arcs)


def threat(symbols: list[tuple]) -> Machine:
    """Marks threats, once with their target, as they were said; one without a target waits for it."""
    arcs = {}
    for waits in (None, (), ("negated",), ("reported",), ("negated", "reported")):
        for x in symbols:
            kind, _, _, at = x
            if kind == THREAT:
                arcs[waits, x] = (None, x, ("threat", *spoken(x))) if at else (spoken(x), x, ())
            elif kind == TARGET and waits is not None:
                arcs[waits, x] = None, x, ("threat", *waits)
            else:
                arcs[waits, x] = waits, x, ()
    return Machine(None, arcs)


def components() -> list[Machine]:
    """The grammar's transducers in the order in which they read each other's output, the first one word classes."""
    flags = (False, True)
    plain = [(k,) for k in range(CLASSES)]
    negated = [(*x, f) for x in plain for f in flags]
    reported = [(*x, f) for x in negated for f in flags]
    aimed = [(*x, f) for x in reported for f in flags]
    return [scope(NEGATION, plain), scope(REPORT, negated), target(reported), insult(aimed), threat(aimed)]


def grammar() -> Machine:
    return reduce(compose, components())


@lru_cache(maxsize=1)
def tables() -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """The composed machine by number: next state and marks, by state and class. State 0 is the start."""
    machine = grammar()
    number = {machine.start: 0}
    for (state, _), (following, _, _) in machine.arcs.items():
        number.setdefault(state, len(number))
        number.setdefault(following, len(number))
    after = [[0] * CLASSES for _ in number]
    marks: list[list[tuple[int, ...]]] = [[()] * CLASSES for _ in number]
    for (state, (kind,)), (following, _, m) in machine.arcs.items():
        after[number[state]][kind] = number[following]
        marks[number[state]][kind] = tuple(MARKS.index(x) for x in m)
    return after, marks


@lru_cache(maxsize=1)
def arcs() -> tuple[list[tuple[int, ...]], list[list[int]], np.ndarray]:
    """(distinct marks of arcs, their number by state and class or -1, how often each has each mark)."""
    marks = tables()[1]
    kinds = sorted({m for row in marks for m in row if m})
    number = {m: i for i, m in enumerate(kinds)}
    counts = np.array([[m.count(i) for i in range(len(MARKS))] for m in kinds], dtype=float)
    return kinds, [[number.get(m, -1) for m in row] for row in marks], counts


CLOSED = {w: k for k, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (THREAT, THREATS), (REPORT, REPORTING)) for w in words}


@dataclass(frozen=True)
class Grammar:
    """A learnt model: lexicon (stem -> strength), weights of the marks, bias."""

    lexicon: dict[str, int]
    weights: tuple[float, ...]
    bias: float

    def arc_weights(self) -> np.ndarray:
        """The weights of the composed machine's kinds of arcs, as arcs() numbers them; none is below zero."""
        return np.maximum(0.0, arcs()[2] @ np.array(self.weights))


def share(k: int, n: int) -> float:
    """What the k-th to the (k + n - 1)-th heaviest weigh in all: 1/k + ..., for k from 1 on."""
    if n < 64:
        return sum(1 / i for i in range(k, k + n))
    return sum(1 / i for i in range(k, k + 8)) + np.log((k + n - 0.5) / (k + 7.5))


def weighed(clauses: Counter, weights: np.ndarray) -> np.ndarray:
    """By kind of arc, how much of its weight a document's clauses hand on.

    clauses: how often each pattern, ((arc, number), ...), occurs. The document weighs the sum of these shares times the
    arcs' weights; arcs and patterns of equal weight are taken in the order of their numbers.
    """
    found = []
    for pattern, n in clauses.items():
        own, k = np.zeros(len(weights)), 1
        for arc, times in sorted(pattern, key=lambda a: (-weights[a[0]], a[0])):
            own[arc] = share(k, times)
            k += times
        found.append((-float(own @ weights), pattern, n, own))
    out, k = np.zeros(len(weights)), 1
    for weight, _, n, own in sorted(found, key=lambda f: f[:2]):
        if weight >= 0:
            break
        out += share(k, n) * own
        k += n
    return out


class Reader:
    """Runs texts through the machine. Words' classes are remembered, in bounded memory."""

    def __init__(self, model: Grammar):
        self.strengths = model.lexicon
        self.longest = max((len(e) for e in model.lexicon), default=0)
        self.known: dict[str, int] = {}

    def classify(self, word: str) -> int:
        """The class of a word as the lexicon transducer reads it."""
        if not word[0].isalpha():
            return STOP
        low = word.lower()
        found = CLOSED.get(low)
        if found is not None:
            return found
        # an entry that is a whole word, of any length, carries an end mark
        s = self.strengths.get(low + "$")
        for n in range(min(len(low), self.longest), SHORTEST - 1, -1):
            if s is not None:
                break
            s = self.strengths.get(low[:n])
        return OTHER if s is None else INSULT + s

    def classes(self, text: str) -> list[int]:
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for w in WORD.findall(text):
            c = known.get(w)
            if c is None:
                c = self.classify(w)
                if len(w) <= 40:
                    known[w] = c
            out.append(c)
        return out

    def readings(self, text: str) -> list[tuple[int, tuple[int, ...]]]:
        """(clause number, marks) of every marked arc on the clauses' paths, in order."""
        classes, out = self.classes(text), []
        if not classes or max(classes) < THREAT:
            return out
        after, marks = tables()
        state, clause = 0, 0
        for kind in classes:
            if kind == STOP:
                state, clause = 0, clause + 1
                continue
            if marks[state][kind]:
                out.append((clause, marks[state][kind]))
            state = after[state][kind]
        return out

    def clauses(self, text: str) -> Counter:
        """How often each pattern of marked arcs, ((arc, number), ...), makes a clause's path."""
        kinds = {m: i for i, m in enumerate(arcs()[0])}
        paths: dict[int, Counter] = {}
        for clause, marks in self.readings(text):
            paths.setdefault(clause, Counter())[kinds[marks]] += 1
        return Counter(tuple(sorted(p.items())) for p in paths.values())


def entries_of(text: str) -> set[str]:
    """The lexicon entries that a text could speak for: its words, marked at their end, and the beginnings of its words."""
    out = set()
    for w in {w.lower() for w in WORD.findall(text)}:
        if w[0].isalpha() and w not in CLOSED and len(w) >= SHORTEST:
            out.add(w + "$")
            out.update(w[:n] for n in range(SHORTEST + 1, min(len(w), LONGEST) + 1))
    return out


def strength(odds: float, toxic: int, all_toxic: int) -> int:
    """0: weak odds; 1: strong odds, few documents; 2: strong odds in a fair share of the toxic documents."""
    return 0 if odds < 4 else 1 if toxic < max(8, 0.02 * all_toxic) else 2


def counted(sample: DataFrame) -> DataFrame:
    """(entry, other, toxic): in how many other and toxic documents each possible entry is."""

    def flush(hits: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(hits[0].keys() | hits[1].keys())
        columns = [pa.array(keys, pa.string()), *(pa.array([h[k] for k in keys], pa.int64()) for h in hits)]
        for h in hits:
            h.clear()
        return pa.RecordBatch.from_arrays(columns, ["entry", "other", "toxic"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches(it):
            for text, y in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                hits[int(y > 0)].update(entries_of(text))
                if len(hits[0]) + len(hits[1]) > REMEMBERED:
                    yield flush(hits)
        yield flush(hits)
        release()

    found = sample.select("text", "y").mapInArrow(count, "entry string, other bigint, toxic bigint")
    return found.groupBy("entry").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))


def learn_lexicon(sample: DataFrame, least: int = 5, odds: float = 1.7) -> dict[str, int]:
    """Strengths of the entries with high smoothed log odds of toxic against other documents, in `least` toxic ones or more.

    All entries are counted over the whole sample, and all that pass stay, but those that repeat others: see told_apart.
    """
    totals = sample.agg(F.sum(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    p, n = totals.p or 0, totals.n or 0
    if not p:
        return {}
    value = F.log((F.col("toxic") + 0.5) / (p + 1.0)) - F.log((F.col("other") + 0.5) / (n - p + 1.0))
    found = counted(sample).where(F.col("toxic") >= least).withColumn("odds", value).where(F.col("odds") >= odds).collect()
    return {e: strength(v, toxic, p) for e, (v, toxic, _) in told_apart({r.entry: (r.odds, r.toxic, r.other) for r in found}).items()}


def told_apart(found: dict[str, tuple[float, int, int]]) -> dict[str, tuple[float, int, int]]:
    """Of entries (odds, toxic, other) that say the same, one: of stems in the same documents the longest, which begins
    fewest words that are none of the learnt; of a stem and a whole word in the same documents the stem; and of a stem and
    a longer one that is no stronger the shorter."""
    out, stems = {}, sorted(e for e in found if not e.endswith("$"))
    for entry, r in sorted(found.items()):
        bare = entry.rstrip("$")
        if bare != entry:
            stem = found.get(bare)
            if stem and stem[1:] == r[1:]:
                continue
        else:
            longer = takewhile(lambda x: x.startswith(bare), islice(stems, bisect_right(stems, bare), None))  # noqa: B023
            if any(found[x][1:] == r[1:] for x in longer):
                continue
        shorter = [found.get(bare[:k]) for k in range(SHORTEST + 1, len(bare) + (entry != bare))]
        if any(x and x[1] > r[1] and x[2] <= r[2] for x in shorter):
            continue
        out[entry] = r
    return out


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS) -> Grammar:
    """The marks' weights from two halves of the bounded sample, each read with the other half's lexicon; then the
    lexicon of the whole sample.

    Null texts are empty ones. Without toxic labels, or without documents, the grammar scores every document a little
    above zero, but for threats.
    """
    sample = materialised(training_sample(documents, labels, label, rows))
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    halves = [sample.where(half == k) for k in (0, 1)]
    lexicons = [learn_lexicon(h) for h in halves]
    got = [r for k in (0, 1) for r in read_clauses(halves[k], lexicons[1 - k])]
    weights, bias = learn_weights([Counter({tuple(map(tuple, c.pattern)): c.times for c in r.clauses}) for r in got], np.array([float(r.y > 0) for r in got]), np.array([float(r["count"]) for r in got]))
    return Grammar(learn_lexicon(sample), tuple(weights), bias)


def read_clauses(sample: DataFrame, lexicon: dict[str, int]) -> list[Row]:
    """(y, clauses, count): the distinct readings of a bounded sample's texts, a few numbers a clause."""

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(Grammar(lexicon, (), 0.0))
        for pdf in it:
            yield pd.DataFrame({"y": pdf.y, "clauses": [[{"pattern": [list(a) for a in p], "times": n} for p, n in sorted(reader.clauses(t).items())] for t in pdf.text]})

    return sample.select("text", "y").mapInPandas(read, "y int, clauses array<struct<pattern:array<array<int>>,times:int>>").groupBy("y", "clauses").count().collect()


def learn_weights(documents: list[Counter], y: np.ndarray, n: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, float]:
    """Weights of the marks and bias. Which arcs count, and with what shares, follows from the weights: both are found in turn."""
    weights = np.array(PRIOR) + np.array([1.0, 4.0, 5.0, 0.0, 0.0, 0.0, 0.0])
    for _ in range(rounds):
        of_arcs = np.maximum(0.0, arcs()[2] @ weights)
        x = np.array([weighed(d, of_arcs) for d in documents]).reshape(-1, len(of_arcs)) @ arcs()[2]
        before = weights
        weights, bias = logistic(x, y, n)
        if np.abs(weights - before).max() < 1e-3:
            break
    return weights, bias


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps within BOUNDS, the weights being held at PRIOR.

    A weight at a bound that the gradient drives further out is left there for the step; the others move together.
    """
    k = len(MARKS)
    w = np.append(np.clip(PRIOR, [lo for lo, _ in BOUNDS], [hi for _, hi in BOUNDS]), -4.0)
    if not n.sum():
        return w[:k], float(w[k])
    low, high = (np.array([*(b[i] for b in BOUNDS), (-30.0, 30.0)[i]]) for i in (0, 1))
    full, held, prior = np.c_[x, np.ones(len(x))], np.array([*HELD, 1e-3]), np.array([*PRIOR, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (n * (p - y)) + held * (w - prior)
        free = ~(((w <= low) & (gradient > 0)) | ((w >= high) & (gradient < 0)))
        hessian = full.T @ (full * (n * p * (1 - p))[:, None]) + np.diag(held)
        step = np.zeros(k + 1)
        step[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        before = w
        w = np.clip(w - step * min(1.0, 1.0 / max(1e-9, np.abs(step).max())), low, high)
        if np.abs(w - before).max() < 1e-6:
            break
    return w[:k], float(w[k])


def probabilities(reader: Reader, model: Grammar, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(probability, number of clauses with a reading) of each text."""
    weights = model.arc_weights()
    found = [reader.clauses(t) for t in texts]
    logits = np.array([weighed(c, weights) @ weights if c else 0.0 for c in found]) + model.bias
    return 1 / (1 + np.exp(-np.clip(logits, -35, 35))), np.array([sum(c.values()) for c in found], dtype="int64")


def score(documents: DataFrame, model: Grammar, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_readings for every row.

    Null and empty texts have no readings and get the bias alone. Texts are read whole, where they are; nothing is
    shuffled. A null doc_id is not held out. Repeated rows are scored each; columns other than doc_id and text are not
    read; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a lexicon learnt from a bounded sample

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m)
        for batch in batches(it):
            p, n = probabilities(reader, m, strings(batch.column(2)))
            values = [pa.array(p), pa.array((p >= threshold).astype("int32")), pa.array(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], ["doc_id", "held_out", "score", "predicted", "n_readings"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int, n_readings bigint"
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)


def keep_clean(documents: DataFrame, model: Grammar, threshold: float = 0.5) -> DataFrame:
    """documents, all their columns as they are, without the rows whose text scores the threshold or more.

    Null and empty texts are scored as score() does; repeated rows go or stay together; an empty table gives no rows.
    """
    shared, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m)
        for batch in batches(it):
            p, _ = probabilities(reader, m, strings(batch.column(at)))
            yield batch.filter(pa.array(p < threshold))

    return documents.mapInArrow(run, documents.schema)


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labels.toxic outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
