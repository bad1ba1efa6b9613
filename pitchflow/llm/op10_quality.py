"""Quality rules: decision lists learned by sequential covering, applied as Spark conditional expressions.

Statistics of a text are column expressions over the whole text. From labelled statistics, rules for poor documents
are learned one after another: a rule grows by the threshold condition that gains most on two thirds of the rows that
no earlier rule covers, and is pruned back on the last third. The list becomes one ordered CASE expression.

Words in repeated windows: each 3-word window's hash and place are packed into one long (as many low bits as places
need) and the longs are sorted. Windows with an equal neighbour may be found twice; these, mostly few, are sorted by
their words, and equal neighbours are the windows found twice or more, whatever their hashes.

Cases: null and empty text have no words and fail the base rule; repeated rows are repeated; without labelled rows the
list is empty and the base rule alone decides; a document with several labels counts with its lowest quality; rows that
share a doc_id all count in learning; a null doc_id has no label; an empty table gives no rows; other columns, whatever
their names, are not read. A text of any length is read whole; its row holds several arrays of its words and windows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm.common import WORD, stored, table

#: Labelled rows from which rules are learned, about.
SAMPLE = 10_000
SYMBOLS = "#*$%&|<>"
MOST_RULES, MOST_CONDITIONS = 12, 3
PRECISION = 0.8
FEWEST = 5

_REPEATED = r"""
element_at(transform(array(filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x <> '')), w ->
  named_struct('n_words', cast(size(w) as bigint), 'n_repeat_words', CASE WHEN size(w) < 3 THEN 0L ELSE
    element_at(transform(array(cast(ceil(log2(size(w) + 1)) as int)), b ->
      element_at(transform(array(sort_array(transform(sequence(0, size(w) - 3), i ->
          coalesce(shiftleft(shiftrightunsigned(xxhash64(w[i], w[i + 1], w[i + 2]), b), b) | cast(i as bigint), 0L)))), s ->
        element_at(transform(array(sort_array(transform(
            filter(s, (x, j) -> shiftrightunsigned(x, b) = shiftrightunsigned(get(s, j - 1), b) OR shiftrightunsigned(x, b) = shiftrightunsigned(get(s, j + 1), b)),
            x -> element_at(transform(array(cast(x & (shiftleft(1L, b) - 1L) as int)), i -> named_struct('t', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'i', i)), 1)))), c ->
          element_at(transform(array(sort_array(transform(
              filter(c, (x, j) -> x.t <=> get(c, j - 1).t OR x.t <=> get(c, j + 1).t), x -> x.i))), p ->
            CASE WHEN size(p) = 0 THEN 0L ELSE
              aggregate(sequence(0, size(p) - 1), 0L, (sum, k) -> sum + least(3, coalesce(get(p, k + 1) - p[k], 3))) END), 1)), 1)), 1)), 1) END)), 1)
"""

#: What rules look at.
FEATURES = {
    "n_words": F.col,
    "mean_word": lambda _: F.col("word_chars") / F.col("n_words"),
    "symbol_share": lambda _: F.col("n_symbols") / F.col("word_chars"),
    "upper_share": lambda _: F.col("n_upper") / F.col("word_chars"),
    "mark_share": lambda _: F.col("n_marks") / F.col("n_words"),
    "dup_line_share": lambda _: F.col("n_dup_lines") / F.col("n_lines"),
    "repeat_share": lambda _: F.col("n_repeat_words") / F.col("n_words"),
}


def statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with the statistics in place of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    own = [c for c in docs.columns if c != "text"]
    counted = docs.select(
        *own,
        F.expr(_REPEATED).alias("counted"),
        without(" \t\n\r\x0b\x0c").cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
        (F.length(text) - without("!")).cast("long").alias("n_marks"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))[0].alias("lines"),
    )
    return counted.select(*own, "counted.n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "counted.n_repeat_words", "n_upper", "n_marks", F.col("lines.n").alias("n_lines"))


def features() -> list[Column]:
    return [F.coalesce(f(name), F.lit(0)).cast("double").alias(name) for name, f in FEATURES.items()]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Condition = tuple[int, bool, float]  # feature, whether at least (else below), threshold


def _holds(x: np.ndarray, rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for feature, at_least, limit in rule:
        out &= (x[:, feature] >= limit) == at_least
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < MOST_CONDITIONS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), inside.sum()
        best: tuple[float, Condition | None] = (1e-9, None)
        for feature in range(x.shape[1]):
            for limit in np.unique(np.quantile(x[inside, feature], np.linspace(0, 1, 41))).tolist():
                above = inside & (x[:, feature] >= limit)
                for at_least in (True, False):
                    part = above if at_least else inside & ~above
                    p1, n1 = (part & bad).sum(), part.sum()
                    if p1 >= FEWEST:
                        gain = float(p1 * (math.log2(p1 / n1) - math.log2(p / n)))  # FOIL's
                        if gain > best[0]:
                            best = gain, (feature, at_least, limit)
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _holds(x, [best[1]])
    return rule


def _worth(x: np.ndarray, bad: np.ndarray, rule: list[Condition]) -> tuple[float, int, int]:
    inside = _holds(x, rule)
    p, n = int((inside & bad).sum()), int(inside.sum())
    return (2 * p - n) / n if n else -1.0, p, n


def learn_list(x: np.ndarray, bad: np.ndarray) -> list[list[Condition]]:
    """Ordered rules for bad rows."""
    rules: list[list[Condition]] = []
    order = np.random.default_rng(10).permutation(len(x))
    x, bad = x[order], bad[order]
    while len(rules) < MOST_RULES and bad.sum() >= FEWEST:
        third = np.arange(len(x)) % 3 == 2
        rule = _grow(x[~third], bad[~third])
        if not rule:
            break
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(x[third], bad[third], r)[0], -len(r)))
        _, p, n = _worth(x, bad, rule)
        if p < FEWEST or p < PRECISION * n:
            break
        rules.append(rule)
        left = ~_holds(x, rule)
        x, bad = x[left], bad[left]
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    rows = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) < math.ceil(1e6 * sample / n))
    # about sample rows of two numbers, whatever the input; the texts they meet are written before anything is counted,
    # for the optimizer would count the whole corpus first
    rows = rows.select(F.col("doc_id").alias("labelled"), "quality")
    joined = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("labelled")).select("quality", "text")
    counted = statistics(stored(joined, "quality-sample")).select("quality", "n_words", "n_repeat_words", *[f.alias(f"feature{i}") for i, f in enumerate(features())])
    values = np.array([tuple(r) for r in counted.collect()], dtype=float).reshape(-1, 3 + len(FEATURES))
    values = values[(values[:, 1] >= 50) & (100 * values[:, 2] <= 50 * values[:, 1])]
    values = values[np.lexsort(values.T)]  # the same order in every run
    return learn_list(values[:, 3:], values[:, 0] == 0) if len(values) else []


def verdict(rules: list[list[Condition]]) -> Column:
    """True for rows that no rule covers: the decision list as an ordered CASE expression over the features."""
    names = list(FEATURES)
    out = F.when(base_failed(), False)
    for rule in rules:
        met = F.lit(True)
        for feature, at_least, limit in rule:
            value = F.coalesce(FEATURES[names[feature]](names[feature]), F.lit(0)).cast("double")
            met = met & (value >= limit if at_least else value < limit)
        out = out.when(met, False)
    return out.otherwise(True)


def judged(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The statistics of every row with base_failed and kept."""
    return statistics(docs.select("doc_id", "text")).withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = judged(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op10_decision_list": op10_decision_list}
ORACLE: dict[str, str] = {}
