"""Toxicity by a weighted finite-state pattern grammar over clauses.

Everything is a deterministic transducer: a table of moves that reads a symbol, goes on to a state and writes symbols.
A lexical transducer reads the letters of a word and writes its symbol: slight, slur, insult, threat, target, negation,
report or none. Five transducers then rewrite the symbols of a sentence, each for one thing:

    negation   marks the slights, slurs, insults and threats behind a negation
    report     marks those behind a verb of saying, across a quotation mark too, or, by a symbol written later, those before one
    target     marks those that a person stands before, or, by a symbol written later, behind
    insult     makes the second slight of a clause a slur, and the second slur an insult
    threat     holds a threat back until there is a target; without one it writes nothing

A last one reads what they leave of a clause and writes the pattern that it matched: slight, slur, insult or threat, aimed
or not, and plain, negated or reported. compose() makes one transducer of the six. A clause without any of the four
matches nothing, whatever else stands in it.

A pattern's weight is that of what was said, plus that of being aimed, of being negated and of being reported, so that
labels that show any of these move it in every pattern. A document's score is the logistic of these weights times log2(1
+ the clauses that show each). The signs of aimed (not below 0), negated and reported (not above 0) are the grammar's.

Slights, slurs and insults are stems learned from about SAMPLE labelled rows; the fewer clean documents show them, the
graver.
Spark counts in how many toxic and other documents each word beginning stands; stems that chance can't explain reach the
driver, however many they are, which the sample bounds, and a row for each labelled document's counts. The other words
start from stems and endings of four languages.

Cases: null and empty text match no pattern and get the score of a text without any; without labelled rows no stem is
known and every score is below one half; repeated rows are repeated; several labels of a document count as toxic if one
is; texts and words are read whole; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm.common import fold, held, stored, table

SAMPLE = 12_000
FOLDS, HELD_OUT = 5, 0
#: Letters of a word's shortest beginning that is a stem, and of the longest; the whole word is one too.
SHORTEST, LONGEST = 4, 24
#: Words whose symbols a worker keeps.
KEPT = 500_000

SLIGHT, SLUR, INSULT, THREAT, TARGET, NEGATION, REPORT = "slight", "slur", "insult", "threat", "target", "negation", "report"
QUOTE, END = "quote", "end"
NEGATED, REPORTED, AIMED = "negated", "reported", "aimed"
SAID = (SLIGHT, SLUR, INSULT, THREAT)
#: What a document's counts are of.
SHOWN = (*SAID, AIMED, NEGATED, REPORTED)
#: Share of toxic documents among those with a stem, from which it is a slur, and an insult.
STRONG = ((0.8, SLUR), (0.95, INSULT))
#: Endings that inflect the stems of a language, and common stems of English, German, French and Spanish.
ENDINGS = {
    "en": " s es d ed ing",
    "de": " e st t en et te ten test tet",
    "fr": "e es ent ez ons er ir é ée és ées ait aient ai as a erai era eront re",
    "es": "o a as e es an en amos ar ó é aron ado aste aré ará arán aría",
}
STEMS = {
    THREAT: {"en": "kill hurt destroy murder beat strangl shoot stab", "de": "töt vernicht umbring erschieß erschlag verprügel", "fr": "tu détrui frapp massacr étrangl", "es": "mat destru golpe estrangul dispar"},
    REPORT: {"en": "say claim write report tell call", "de": "sag behaupt schreib meld erzähl nenn", "fr": "affirm écri racont déclar appel", "es": "afirm escrib cuent declar llam"},
}
WHOLE = {
    TARGET: "you your yours he she they them him her his their du dich dir euch sie ihr ihn ihm ihnen dein tu te toi vous il ils elle elles lui leur ton tú te ti usted ustedes él ella ellos ellas vosotros",
    NEGATION: "not no never nobody none don't isn't nicht kein keine keinen keiner nie niemand ne pas jamais aucun aucune personne nunca jamás ningún ninguna nadie tampoco",
    REPORT: "said wrote written told sagte schrieb erzählte nannte dit disait écrit écrivit dijo dice decía escribió contó",
}

Symbol = str | tuple[str, ...]


class Transducer:
    """Moves from state 0 by (state, symbol) to (state, written symbols)."""

    def __init__(self, start, step: Callable, alphabet: Iterable[Symbol]):
        alphabet = tuple(alphabet)
        number, waiting, self.moves = {start: 0}, [start], {}
        for state in waiting:  # grows as states are met
            for symbol in alphabet:
                to, written = step(state, symbol)
                if to not in number:
                    number[to] = len(number)
                    waiting.append(to)
                self.moves[number[state], symbol] = number[to], tuple(written)
        self.alphabet, self.states = alphabet, len(number)

    def writes(self) -> set[Symbol]:
        return {x for _, written in self.moves.values() for x in written}

    def run(self, symbols: Iterable[Symbol], state: int = 0) -> tuple[int, tuple[Symbol, ...]]:
        out: tuple[Symbol, ...] = ()
        for symbol in symbols:
            state, written = self.moves[state, symbol]
            out += written
        return state, out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that writes what second writes of what first writes."""

    def step(state, symbol):
        a, written = first.moves[state[0], symbol]
        b, out = second.run(written, state[1])
        return (a, b), out

    return Transducer((0, 0), step, first.alphabet)


def _said(symbol: Symbol) -> bool:
    return isinstance(symbol, tuple) and symbol[0] in SAID


def _negation(state, x):
    if x == NEGATION:
        return True, ()
    return state and x != END, ((*x, NEGATED) if _said(x) and state else x,)


def _report(state, x):
    """States: open, behind a verb of saying, behind something said, or behind that and a quotation mark."""
    if x == REPORT:
        return "verb", (("back", REPORTED), END) if state == "quoted" else (("back", REPORTED),) if state == "said" else ()
    if x == QUOTE:
        return ("verb", ()) if state == "verb" else ("quoted", ()) if state in ("said", "quoted") else ("open", (END,))
    if x == END:
        return "open", (END,)
    if _said(x):
        return ("verb", ((*x, REPORTED),)) if state == "verb" else ("said", ((END,) if state == "quoted" else ()) + (x,))
    return state, () if state == "quoted" else (x,)  # who says it isn't who is meant


def _target(state, x):
    """States: open, behind a target, or behind something said without one."""
    if x == TARGET:
        return "target", (("back", AIMED),) if state == "said" else ()
    if x == END:
        return "open", (END,)
    if _said(x):
        return ("target", ((*x, AIMED),)) if state == "target" else ("said", (x,))
    return state, (x,)


def _insult(state, x):
    if x == END:
        return False, (END,)
    if _said(x) and x[0] in (SLIGHT, SLUR):
        return True, ((SAID[SAID.index(x[0]) + 1], *x[1:]) if state else x,)
    return state, (x,)


def _threat(state, x):
    if x == END:
        return (), (END,)
    if _said(x) and x[0] == THREAT and AIMED not in x:
        return x, ()
    if state and x == ("back", AIMED):
        return (), ((*state, AIMED), x)
    if state and x == ("back", REPORTED):
        return (*state, REPORTED) if REPORTED not in state else state, (x,)
    return state, (x,)


def _clause(state, x):
    """State: the gravest that was said, whether aimed, and how: plain weighs more than negated, that more than reported."""
    what, aimed, how = state
    if x == END:
        return (-1, False, -1), ((SAID[what], AIMED if aimed else "", ("reported", "negated", "plain")[how]),) if what >= 0 else ()
    if _said(x):
        return (max(what, SAID.index(x[0])), aimed or AIMED in x, max(how, 0 if REPORTED in x else 1 if NEGATED in x else 2)), ()
    if what >= 0 and x[0] == "back":
        return (what, aimed or x[1] == AIMED, 0 if x[1] == REPORTED else how), ()
    return state, ()


@cache
def grammar() -> Transducer:
    """From the symbols of words and marks to the patterns of clauses."""
    rules = ((False, _negation), ("open", _report), ("open", _target), (False, _insult), ((), _threat), ((-1, False, -1), _clause))
    alphabet: Iterable[Symbol] = [*((s,) for s in SAID), TARGET, NEGATION, REPORT, QUOTE, END]
    parts = []
    for start, step in rules:
        parts.append(Transducer(start, step, alphabet))
        alphabet = sorted(parts[-1].writes(), key=str)
    return reduce(compose, parts)


class Lexicon:
    """The lexical transducer: a deterministic tree of letters, whose states hold the symbol of a word that ends there
    and, for learned stems, of any word that goes on from there (the longest stem's)."""

    def __init__(self, stems: dict[str, str]):
        self.moves: list[dict[str, int]] = [{}]
        self.ends: dict[int, Symbol] = {}
        self.goes_on: dict[int, Symbol] = {}
        for symbol, own in STEMS.items():
            for lang, words in own.items():
                for stem, ending in product(words.split(), ENDINGS[lang].split(" ")):
                    self.ends.setdefault(self._add(stem + ending), (symbol,) if symbol in SAID else symbol)
        for symbol, words in WHOLE.items():
            for word in words.split():
                self.ends[self._add(word)] = symbol
        for stem, symbol in stems.items():
            self.goes_on[self._add(stem)] = (symbol,)
        self.known: dict[str, Symbol | None] = {}

    def _add(self, word: str) -> int:
        state = 0
        for letter in word:
            if letter not in self.moves[state]:
                self.moves[state][letter] = len(self.moves)
                self.moves.append({})
            state = self.moves[state][letter]
        return state

    def read(self, word: str) -> Symbol | None:
        state, found = 0, None
        for letter in word:
            state = self.moves[state].get(letter, -1)
            if state < 0:
                return found
            found = self.goes_on.get(state, found)
        return found or self.ends.get(state)

    def symbol(self, word: str) -> Symbol | None:
        if word not in self.known:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[word] = self.read(word)
        return self.known[word]


_SENTENCE = re.compile(r"[.!?;\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’]t\b)?|[:\"“”«»„]")
_LETTERS = re.compile(r"[^\W\d_]+")


class Grammar:
    def __init__(self, stems: dict[str, str]):
        self.lexicon, self.machine = Lexicon(stems), grammar()

    def patterns(self, text: str | None) -> list[tuple[str, str, str]]:
        """The pattern of each clause that matches one."""
        found: list[tuple[str, str, str]] = []
        if not text:
            return found
        symbol, moves = self.lexicon.symbol, self.machine.moves
        text = text.lower()
        hits = {w for w in set(_LETTERS.findall(text)) if (s := symbol(w)) and s[0] in SAID}
        if not hits:
            return found
        for sentence in _SENTENCE.split(text):
            if hits.isdisjoint(_LETTERS.findall(sentence)):
                continue
            state = 0
            for token in _TOKEN.findall(sentence):
                if s := symbol(token.replace("’", "'")) if token[0].isalpha() else QUOTE:
                    state, written = moves[state, s]
                    found += written
            found += moves[state, END][1]
        return found

    def counts(self, text: str | None) -> list[int]:
        """How many clauses show each of SHOWN."""
        out = dict.fromkeys(SHOWN, 0)
        for what, aimed, how in self.patterns(text):
            for x in (what, aimed, how):
                if x in out:
                    out[x] += 1
        return list(out.values())


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of about sample labelled rows that aren't held out."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("labelled", F.lit(2)), F.lit(1_000_000)) < math.ceil(1e6 * sample / n))
    # about sample rows of two numbers, whatever the input
    return docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("labelled")).filter("text is not null").select("text", "toxic")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def learn_stems(rows: DataFrame) -> dict[str, str]:
    """Word beginnings whose documents are toxic far more often than chance allows: the least likely first (of equals the
    longest), without those that begin one that is kept already or go on from it."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stems = lambda w: F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(w), F.lit(LONGEST))), lambda n: F.substring(w, F.lit(1), n))
    parts = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= SHORTEST), lambda w: F.when(F.length(w) > LONGEST, F.array_append(stems(w), w)).otherwise(stems(w))))
    total = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, toxic = int(total[0]), int(total[1])
    if not 0 < toxic < n:
        return {}
    counts = rows.select("toxic", F.explode(F.array_distinct(parts)).alias("stem")).groupBy("stem").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    base = toxic / n
    # log of the chance that t of n documents are toxic, bounded by the divergence of t / n from the base rate
    share = F.least(F.col("t") / F.col("n"), F.lit(1 - 1e-9))
    chance = F.col("n") * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
    # a word doubtful by itself can't pass, however few were tried
    likely = stored(counts.withColumn("tried", F.lit(1)).withColumn("gain", F.when(share > max(0.6, 3 * base), chance).otherwise(0)).groupBy((F.col("gain") > 2).alias("likely"), F.when(F.col("gain") > 2, F.col("stem")).alias("stem")).agg(F.sum("tried").alias("tried"), F.max("n").alias("n"), F.max("t").alias("t"), F.max("gain").alias("gain")), "stems")
    tried = likely.agg(F.coalesce(F.sum("tried"), F.lit(1))).first()[0]
    found = likely.filter(F.col("likely") & (F.col("gain") > math.log(tried) + 2)).collect()
    kept: dict[str, str] = {}
    begins: set[str] = set()  # of stems kept
    for r in sorted(found, key=lambda r: (-round(r["gain"], 9), -len(r["stem"]), r["stem"])):
        stem, own = r["stem"], (r["t"] + base) / (r["n"] + 1)
        if stem not in begins and not any(stem[:k] in kept for k in range(SHORTEST, len(stem))):
            kept[stem] = max([SLIGHT, *(s for least, s in STRONG if own >= least)], key=SAID.index)
            begins |= {stem[:k] for k in range(SHORTEST, len(stem) + 1)}
    return kept


#: Weights of SHOWN before any label is seen, and behind them the intercept's; bounds that are the grammar's.
PRIOR = (0.7, 1.5, 2.5, 2.5, 0.5, -2.0, -2.0)
BOUNDS = {AIMED: (0.0, math.inf), NEGATED: (-math.inf, 0.0), REPORTED: (-math.inf, 0.0)}


def learn_weights(counts: list[tuple[tuple[int, ...], int, int]]) -> list[float]:
    """Intercept and a weight for each of SHOWN; counts: (clauses that show each, documents, toxic ones). Logistic
    regression with a ridge about PRIOR, on log2(1 + clauses); a weight beyond its bound is held there."""
    x = np.array([[1.0, *np.log2(1 + np.array(c))] for c, _, _ in counts]) if counts else np.zeros((0, 1 + len(SHOWN)))
    n, t = (np.array([c[k] for c in counts], dtype=float) for k in (1, 2))
    prior, ridge = np.array([-2.0, *PRIOR]), np.array([0.01, *[0.5] * len(SHOWN)])
    low, high = (np.array([-math.inf if k == 0 else math.inf, *[BOUNDS.get(s, (-math.inf, math.inf))[k] for s in SHOWN]]) for k in (0, 1))
    weights, free = prior.copy(), np.ones(len(prior), dtype=bool)
    while True:
        for _ in range(100):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = (x.T @ (t - n * p) - ridge * (weights - prior))[free]
            curve = ((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge))[np.ix_(free, free)]
            step = np.clip(np.linalg.solve(curve, slope), -2, 2)
            weights[free] += step
            if np.abs(step).max() < 1e-9:
                break
        beyond = free & ((weights < low) | (weights > high))
        if not beyond.any():
            return weights.tolist()
        weights[beyond], free = np.clip(weights, low, high)[beyond], free & ~beyond


def _matcher(stems: dict[str, str]):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity", tuple)
        own = Grammar(stems)
        for batch in batches:
            found = [own.counts(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.int32()))], ["key", "shown"])

    return match


def matched(rows: DataFrame, stems: dict[str, str]) -> DataFrame:
    """(key, shown) of rows (key long, text)."""
    return rows.mapInArrow(_matcher(stems), "key long, shown array<int>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, str], list[float]]:
    rows = stored(labelled_sample(docs, labels, sample), "toxicity-sample")
    stems = learn_stems(rows)
    seen = matched(rows.select(F.col("toxic").cast("long").alias("key"), "text"), stems)
    counts = seen.groupBy("shown").agg(F.count("*").alias("n"), F.sum("key").alias("t")).collect()
    return stems, learn_weights(sorted((tuple(r["shown"]), r["n"], r["t"]) for r in counts))


def score(docs: DataFrame, model: tuple[dict[str, str], list[float]]) -> DataFrame:
    """(doc_id, held_out, score, predicted, shown) of every row; shown: clauses that show each of SHOWN."""
    stems, (base, *weights) = model
    found = matched(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), stems)
    total = F.lit(base)
    for i, w in enumerate(weights):
        total = total + F.log2(1 + F.col("shown")[i]) * w
    chance = 1 / (1 + F.exp(-total))
    return found.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), chance.alias("score"), F.when(chance >= 0.5, 1).otherwise(0).alias("predicted"), "shown")


def op2_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels)).drop("shown")


QUERIES = {"op2_toxicity_grammar": op2_toxicity_grammar}
ORACLE: dict[str, str] = {}
