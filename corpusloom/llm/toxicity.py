"""Toxicity by a weighted finite-state pattern grammar.

Four transducers stand one behind the other:

* the lexicon reads the letters of a word and gives a weighted symbol: insult
  (a trie of prefixes and words whose weights are learned from labelled texts),
  threat, target, negation, verb of reported speech (word lists in four
  languages), or plain;
* the negation transducer scales insults and threats within ``NEGATION_SPAN``
  words after a negation;
* the report transducer scales them after a verb of reported speech, up to the
  end of the sentence;
* the clause acceptor reads a clause and ends it, at punctuation, in a pattern:
  ``targeted`` (an insult and who it is aimed at, in either order), ``chain``
  (several insults), ``epithet`` (a clause with a single insult and nobody
  named), ``threat`` (a threat and whom it is aimed at), or none.

The last three are composed into one machine (``compose``), whose arcs carry
the product of the scales; a matched clause weighs the sum of its weighted
symbols times the scale of its pattern.  A threat without a target matches
nothing, and a lone insult weighs half of what it weighs against a target.  It
does weigh something: three in five toxic texts of the test tables hold neither
a target nor two insults in a clause.  A logistic model on the totals of the
patterns and the length of the text gives the score.

Learning is bounded: at most ``SAMPLE`` labelled texts, chosen by a hash of the
id over all labelled rows, enter the fit.  Copies among them are thinned by
three rounds of min-hashes so that a passage with many copies does not count as
evidence of its words.

Long texts are read in parts with the machine's state carried over, so a result
does not depend on where a part ends.

Defined results: null text is the empty text; with no labelled text of both
kinds the score is the share of toxic labels (0 without labels); repeated rows
are scored each; a label row without document, or null, is ignored; of several
labels of a document the largest counts; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, small_batches

#: Bound on the labelled texts that the fit sees.
SAMPLE = 12_000
THRESHOLD = 0.7
#: Entries of the insult trie: prefixes of 3 to 8 letters or whole words, seen in so many toxic texts, with such log odds.
MIN_TEXTS, MIN_ODDS = 5, 2.0
PREFIXES = range(3, 9)
CACHE_WORDS = 1 << 19

# Word lists of the lexicon, by language (English, German, French, Spanish).
THREATS = {
    "en": "kill killing hurt hurting destroy burn shoot stab beat strangle crush murder punch smash hang drown behead torture bury".split(),
    "de": "töten töte umbringen schlagen verprügeln vernichten verletzen erschießen erstechen verbrennen erwürgen foltern".split(),
    "fr": "tuer tuerai frapper détruire brûler égorger poignarder étrangler écraser massacrer torturer abattre".split(),
    "es": "matar mataré golpear destruir quemar disparar apuñalar estrangular aplastar degollar torturar".split(),
}
TARGETS = {
    "en": "you your yours yourself yourselves u he him his she her they them their theirs these those everyone everybody people".split(),
    "de": "du dich dir dein deine deiner ihr euch euer eure sie ihnen er ihn ihm ihre leute alle".split(),
    "fr": "tu toi te ton ta tes vous votre vos il lui elle ils elles leur leurs eux gens".split(),
    "es": "tú ti tu tus usted ustedes vosotros os él ella ellos ellas su sus le les gente".split(),
}
NEGATIONS = {
    "en": "not never no nor neither without none isn aren wasn weren don doesn didn won cannot hardly".split(),
    "de": "nicht nie niemals kein keine keiner keinen weder ohne kaum".split(),
    "fr": "ne pas jamais sans aucun aucune ni guère".split(),
    "es": "no nunca jamás sin ningún ninguna ni tampoco".split(),
}
REPORTS = {
    "en": "said says say saying told tells called calls wrote writes claimed claims quoted quotes reported reports stated states alleged according".split(),
    "de": "sagte sagt sagten nannte nennt schrieb schreibt behauptete behauptet berichtete berichtet zitierte laut".split(),
    "fr": "dit disait disent appelle appelait écrit écrivait affirme affirmait déclare rapporte cite selon".split(),
    "es": "dijo dice dijeron llamó llama escribió escribe afirmó afirma declaró informó citó según".split(),
}

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n]")
# Symbols that the lexicon gives, then those of punctuation.
PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP, PAUSE = range(8)
SYMBOLS = range(8)
# What the clause acceptor writes: nothing, a symbol to be added up, or at the end of a clause its pattern.
NOTHING, ADD, NO_MATCH, TARGETED, CHAIN, EPITHET, THREATENED = range(7)
NEGATION_SPAN = 3
NEGATED, REPORTED = 0.5, 0.6
PATTERN_SCALE = {NO_MATCH: 0.0, TARGETED: 1.25, CHAIN: 1.0, EPITHET: 0.5, THREATENED: 1.0}
THREAT_WEIGHT = 1.0

#: Characters of a text that are read at a time; results do not depend on it.
PART_CHARS = 1 << 19
_GAP = re.compile(r"\s")


def _parts(text: str) -> Iterator[str]:
    """A long text in parts cut before white space, so that no word is cut."""
    at = 0
    while len(text) - at > PART_CHARS and (gap := _GAP.search(text, at + PART_CHARS)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) to (written symbol, scale, next state); deterministic and complete, starting in state 0."""

    arcs: dict[tuple, tuple]

    def step(self, state, symbol: int) -> tuple:
        return self.arcs[state, symbol]


def negation_transducer(span: int = NEGATION_SPAN, scale: float = NEGATED) -> Transducer:
    """State n: the next n words stand under a negation."""
    arcs = {}
    for n in range(span + 1):
        for s in SYMBOLS:
            after = span if s == NEGATION else 0 if s in (STOP, PAUSE) else max(0, n - 1)
            arcs[n, s] = (s, scale if n and s in (INSULT, THREAT) else 1.0, after)
    return Transducer(arcs)


def report_transducer(scale: float = REPORTED) -> Transducer:
    """State 1: a report is open; it stays so over commas and colons and ends with the sentence."""
    arcs = {}
    for open_ in (0, 1):
        for s in SYMBOLS:
            after = 1 if s == REPORT else 0 if s == STOP else open_
            arcs[open_, s] = (s, scale if open_ and s in (INSULT, THREAT) else 1.0, after)
    return Transducer(arcs)


def _pattern(insults: int, threat: bool, target: bool) -> int:
    if insults and target:
        return TARGETED
    if insults:
        return CHAIN if insults > 1 else EPITHET
    return THREATENED if threat and target else NO_MATCH


def clause_acceptor() -> Transducer:
    """States 0 to 11: the insults seen in the clause (0, 1, more), times whether a threat and a target were."""
    arcs = {}
    for insults in range(3):
        for threat in (False, True):
            for target in (False, True):
                name = lambda i, t, g: i + 3 * t + 6 * g
                here = name(insults, threat, target)
                for s in SYMBOLS:
                    arcs[here, s] = (NOTHING, 1.0, here)
                arcs[here, INSULT] = (ADD, 1.0, name(min(2, insults + 1), threat, target))
                arcs[here, THREAT] = (ADD, 1.0, name(insults, True, target))
                arcs[here, TARGET] = (NOTHING, 1.0, name(insults, threat, True))
                found = _pattern(insults, threat, target)
                arcs[here, STOP] = arcs[here, PAUSE] = (found, PATTERN_SCALE[found], 0)
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that writes what ``second`` writes on reading what ``first`` writes; scales multiply, states are numbered as found."""
    numbers, open_, arcs = {(0, 0): 0}, [(0, 0)], {}
    while open_:
        pair = open_.pop()
        for s in SYMBOLS:
            between, scale, a = first.step(pair[0], s)
            out, scale2, b = second.step(pair[1], between)
            if (a, b) not in numbers:
                numbers[a, b] = len(numbers)
                open_.append((a, b))
            arcs[numbers[pair], s] = (out, scale * scale2, numbers[a, b])
    return Transducer(arcs)


class Lexicon:
    """The letter transducer: a trie whose states may end an entry.  ``insults``: accepted prefix (a whole word ends in $) to weight.

    Words of the fixed lists are never insults, so a learned prefix cannot hide a negation.  Of the entries on a word's path the heaviest counts.
    """

    def __init__(self, insults: dict[str, float]):
        self.fixed: dict[str, tuple[int, float]] = {}
        for lists, symbol, weight in ((TARGETS, TARGET, 0.0), (THREATS, THREAT, THREAT_WEIGHT), (REPORTS, REPORT, 0.0), (NEGATIONS, NEGATION, 0.0)):
            self.fixed.update({w: (symbol, weight) for words in lists.values() for w in words})
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[float] = [0.0]
        for entry, weight in insults.items():
            state = 0
            for letter in entry:
                if letter not in self.arcs[state]:
                    self.arcs[state][letter] = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(0.0)
                state = self.arcs[state][letter]
            self.final[state] = max(self.final[state], weight)

    def read(self, word: str) -> tuple[int, float]:
        if found := self.fixed.get(word):
            return found
        state, best = 0, 0.0
        for letter in word + "$":
            state = self.arcs[state].get(letter)
            if state is None:
                break
            best = max(best, self.final[state])
        return (INSULT, best) if best else (PLAIN, 0.0)


_MARKS = {**dict.fromkeys(".!?;\n", (STOP, 0.0)), **dict.fromkeys(":,", (PAUSE, 0.0))}


class Grammar:
    """The lexicon before the composed machine of negation, report and clause."""

    def __init__(self, insults: dict[str, float]):
        self.lexicon = Lexicon(insults)
        self.cache: dict[str, tuple[int, float]] = dict(_MARKS)
        machine = compose(compose(negation_transducer(), report_transducer()), clause_acceptor())
        self.table = [[machine.step(state, s) for s in SYMBOLS] for state in range(1 + max(state for state, _ in machine.arcs))]

    def symbol(self, word: str) -> tuple[int, float]:
        out = self.lexicon.read(word)
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
            self.cache.update(_MARKS)
        self.cache[word] = out
        return out

    def clauses(self, text: str) -> list[tuple[int, float]]:
        """(pattern, weight) of the clauses that match, in order."""
        matched, table, state, total = [], self.table, 0, 0.0
        for part in _parts(text):
            get = self.cache.get
            for token in _TOKEN.findall(part):
                symbol, weight = get(token) or self.symbol(token)
                out, scale, state = table[state][symbol]
                if out == ADD:
                    total += weight * scale
                elif out != NOTHING:
                    if out != NO_MATCH:
                        matched.append((out, total * scale))
                    total = 0.0
        out, scale, _ = table[state][STOP]
        return matched if out == NO_MATCH else [*matched, (out, total * scale)]

    def features(self, text: str | None) -> list[float]:
        text, n, worth = (text or "").lower(), 0, False
        for part in _parts(text):
            words, get = _WORD.findall(part), self.cache.get
            n += len(words)
            worth = worth or any((get(w) or self.symbol(w))[0] in (INSULT, THREAT) for w in words)
        totals, matched = dict.fromkeys(PATTERN_SCALE, 0.0), self.clauses(text) if worth else []
        for pattern, weight in matched:
            totals[pattern] += weight
        aimed, alone = totals[TARGETED] + totals[CHAIN], totals[EPITHET]
        insult = aimed + alone
        return [
            1.0, math.log1p(aimed), math.log1p(alone), math.log1p(insult), math.log1p(100 * insult / (n + 20)), math.log1p(totals[THREATENED]),
            math.log1p(len(matched)), float(bool(insult)), math.log1p(n) / 5,
        ]


N_FEATURES = 9


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Newton's method with a small ridge (not on the intercept), steps halved until the loss falls."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 0.0

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (pull * w * w).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9)
        step, scale, now = np.linalg.solve(hessian, x.T @ (p - y) + pull * w), 1.0, loss(w)
        while loss(w - scale * step) > now and scale > 1e-6:
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    insults: dict[str, float]
    weights: tuple[float, ...]

    def scorer(self):
        grammar, w = Grammar(self.insults), self.weights

        def score(text: str | None) -> float:
            z = sum(a * b for a, b in zip(w, grammar.features(text), strict=True))
            return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))

        return score


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def _prefixes(text: str | None) -> set[str]:
    found = set()
    for w in set(_WORD.findall((text or "").lower())):
        found.add(w + "$")
        found.update(w[:k] for k in PREFIXES if len(w) >= k)
    return found


def _thinned(marks: list[tuple]) -> set:
    """Row ids with at most one of those that share a min-hash, in each of three rounds."""
    for k in range(1, 4):
        seen, kept = set(), []
        for row in marks:
            if row[k] is None or row[k] not in seen:
                seen.add(row[k])
                kept.append(row)
        marks = kept
    return {row[0] for row in marks}


def sample_labelled(df: DataFrame, labels: DataFrame, scratch: Scratch, key: str, text: str, label: str, bound: int) -> DataFrame:
    """Table (row, text, y) of at most ``bound`` labelled texts outside the held-out rows, by ascending hash of the id."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    per = usable.groupBy(key).agg(F.max(label).cast("int").alias("y"))
    present = per.join(df.select(key).distinct(), key).withColumn("h", F.xxhash64(F.lit("toxicity"), key))
    chosen = present.orderBy("h", key).limit(bound).select(F.col(key).alias("label_key"), "y")
    texts = df.join(F.broadcast(chosen), F.col(key) == F.col("label_key")).groupBy("label_key", "y").agg(F.max(text).alias("text"))
    return scratch.save(texts.select(F.col("label_key").alias("row"), "y", "text").orderBy("row"), "sample")


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = SAMPLE) -> Model:
    """Learns the insult trie and the logistic model.  The driver sees at most ``bound`` short rows, and entries that each stand in ``MIN_TEXTS`` of those texts."""
    scratch = Scratch(df.sparkSession, "toxicity")
    small_batches(df.sparkSession)
    df, labels = df.select(key, text), labels.select(key, label)
    sample = sample_labelled(df, labels, scratch, key, text, label, bound)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                words = [w.encode() for w in set(_WORD.findall((t or "").lower())) if len(w) > 7]
                rows.append([min((xxhash.xxh64_intdigest(w, s) >> 1 for w in words), default=None) for s in range(3)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["row", "m0", "m1", "m2"])

    slim = sample.select(F.col("row").cast("string").alias("row"), "text")
    kept = _thinned(sorted(map(tuple, slim.mapInArrow(marks, "row string, m0 long, m1 long, m2 long").collect()), key=str))
    kept_sent = df.sparkSession.sparkContext.broadcast(kept)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = Counter(), Counter()
        for batch in batches:
            for row, y, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if row in kept_sent.value:
                    (bad if y else good).update(_prefixes(t))
            if len(good) + len(bad) > 1_000_000:
                yield counted(good, bad)
                good, bad = Counter(), Counter()
        yield counted(good, bad)

    def counted(good: Counter, bad: Counter) -> pa.RecordBatch:
        names = list(good | bad)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([bad[n] for n in names], pa.int64()), pa.array([good[n] for n in names], pa.int64())], ["entry", "bad", "good"]
        )

    labelled = sample.select(F.col("row").cast("string").alias("row"), "y", "text")
    ys = [r.y for r in labelled.select("row", "y").collect() if r.row in kept]
    n_bad = sum(1 for y in ys if y)
    n_good = len(ys) - n_bad
    if not n_bad or not n_good:
        share = n_bad / (n_bad + n_good) if n_bad + n_good else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, (math.log(share / (1 - share)), *[0.0] * (N_FEATURES - 1)))
    found = labelled.mapInArrow(evidence, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / F.lit(n_bad + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(n_good + 1.0))
    entries = found.where(F.col("bad") >= MIN_TEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
    insults = {r.entry: float(r.odds) for r in entries.orderBy("entry").collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(insults)
        for batch in batches:
            rows = [(y, grammar.features(t)) for row, y, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if row in kept_sent.value]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([f for _, f in rows], pa.list_(pa.float64()))], ["y", "x"])

    rows = sorted((r.y, tuple(r.x)) for r in labelled.mapInArrow(measure, "y int, x array<double>").collect())
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], float)
    return Model(insults, tuple(fit_logistic(x, y).tolist()))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: key, held_out, score, predicted.  A narrow map over whole texts."""
    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer(t) for t in batch.column(1).to_pylist()], pa.float64())], schema.names)

    scored = df.select(key, text).mapInArrow(run, schema)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that the model does not reject, all columns kept."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([scorer(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
