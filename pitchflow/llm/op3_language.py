"""Language identification by word-first backoff.

A word that training has seen scores by its log frequency in each language. An unseen word backs off to its character
n-grams, the longest first: the mean log frequency of its known 4-grams, else of its 3-grams, and so on. A text's
language is the one with the largest mean over all of its words, and its score the logistic share of that mean, so that
a long text is no surer than its words: a text of two languages in equal parts scores near one half.

The model is fitted on a sample of about SAMPLE labelled rows, counted by Spark. Every word and n-gram that the sample
shows at least SEEN times in a language is known, however many there are; rarer ones back off like unseen ones. So the
tables, which tasks receive, are bounded by the sample. The sample goes by document, not by text alone, so that many
copies of one text don't enter or stay out as a whole. N-grams come from whole words however long, in learning by
pieces of PIECE letters.

Cases: null text, and text without a letter, give `und` with score 0; ties go to the language first in order; with no
labelled rows every text is `und`; repeated rows are repeated; texts are read whole; an empty table gives no rows;
other columns are kept by keep_identified, whatever their names, and not read by identify.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm.common import fold, held, table

SAMPLE = 20_000
#: Least count of a word or n-gram of a language that is known.
SEEN = 5
ORDERS = (4, 3, 2, 1)
#: Places of a word whose n-grams are taken at a time.
PIECE = 256
FOLDS, HELD_OUT = 4, 2
#: A text in two languages in equal parts scores about one half, one of three or four less.
MIN_SCORE = 0.45
#: Words whose scores a worker keeps.
KEPT = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")


def fit(labelled: DataFrame, sample: int = SAMPLE, seen: int = SEEN) -> dict:
    """Model from (doc_id, text, lang). Returns languages and, for words and each n-gram order, log frequencies."""
    rows = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    n = rows.count()
    if n > sample:  # about as many, chosen by a hash of the id, and of the text for rows that share one or have none
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1_000_000)) < math.ceil(1e6 * sample / n))
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("item"))
    words = words.groupBy("lang", "item").agg(F.count("*").alias("n"))
    # a word gives itself, as order 0, and all n-grams of its marked letters: those that start in each piece
    pieces = words.select("lang", "n", "item", F.explode(F.expr(f"sequence(0, (length(item) + 1) div {PIECE})")).alias("p"))
    grams = ", ".join(f"transform(IF(p > 0 AND length(m) < {k}, array(), sequence(1, greatest(least({PIECE}, length(m) - {k - 1}), 1))), i -> named_struct('order', {k}, 'item', substring(m, i, {k})))" for k in ORDERS)
    own = "IF(p > 0, array(), array(named_struct('order', 0, 'item', item)))"
    parts = F.expr(f"element_at(transform(array(substring(concat('^', item, '$'), p * {PIECE} + 1, {PIECE + max(ORDERS) - 1})), m -> concat({own}, {grams})), 1)")
    items = pieces.select("lang", "n", F.explode(parts).alias("part")).groupBy("lang", "part.order", "part.item").agg(F.sum("n").alias("n"))
    totals = items.groupBy("lang", "order").agg(F.sum("n").alias("total"))  # with the rarer ones
    found = items.filter(F.col("n") >= seen).join(totals, ["lang", "order"]).toArrow().to_pylist()
    langs = sorted({r["lang"] for r in found})
    model: dict = {"langs": langs, "tables": {}}
    for order in (0, *ORDERS):
        counts: dict[str, list[float]] = {}
        total = {x: 1.0 for x in langs}
        for r in found:
            if r["order"] == order:
                counts.setdefault(r["item"], [0.0] * len(langs))[langs.index(r["lang"])] = r["n"]
                total[r["lang"]] = r["total"]
        base = [math.log(total[x] + len(counts) * 0.5) for x in langs]
        model["tables"][order] = {item: [math.log(c + 0.5) - b for c, b in zip(cs, base)] for item, cs in counts.items()}
    return model


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.tables = model["langs"], model["tables"]
        words = self.tables[0]
        self.base = {w: i for i, w in enumerate(words)}
        self.known = dict(self.base)
        self.rows = np.zeros((KEPT + len(words), max(1, len(self.langs))))
        if words:
            self.rows[: len(words)] = list(words.values())

    def back_off(self, word: str) -> list[float]:
        marked = f"^{word}$"
        for order in ORDERS:
            grams, n, total = self.tables[order], 0, [0.0] * len(self.langs)
            for first in range(0, len(marked) - order + 1, PIECE):
                last = min(first + PIECE, len(marked) - order + 1)
                if got := [g for k in range(first, last) if (g := grams.get(marked[k : k + order]))]:
                    n, total = n + len(got), [t + sum(x) for t, x in zip(total, zip(*got))]
            if n:
                return [t / n for t in total]
        return [0.0] * len(self.langs)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _LETTERS.findall(text.lower()) if text else []
        if not words or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        for k in range(0, len(words), 100_000):
            part = words[k : k + 100_000]
            known = self.known
            if len(known) + len(part) > len(self.rows):
                known = self.known = dict(self.base)
            for w in part:
                if w not in known:
                    self.rows[len(known)] = self.back_off(w)
                    known[w] = len(known)
            total += self.rows[[known[w] for w in part]].sum(axis=0)
        mean = total / len(words)
        best = int(np.argmax(mean))
        return self.langs[best], float(1 / np.exp(mean - mean[best]).sum())


def _predictor(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language", tuple)
        scorer = Scorer(model.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["key", "lang_pred", "score"])

    return predict


def predictions(rows: DataFrame, model: dict) -> DataFrame:
    """(key, lang_pred, score) of rows (key long, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predictor(shared), "key long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows that aren't held out."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = predictions(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), model)
    return found.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows that are `und` or whose language is doubtful (score below min_score)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(~held_out(F.col("doc_id")))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language", tuple)
        scorer = Scorer(model.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                found = [scorer.predict(t.as_py()) for t in part.column("text")]
                yield part.filter(pa.array([x != "und" and s >= min_score for x, s in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op3_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op3_language_backoff": op3_language_backoff}
ORACLE: dict[str, str] = {}
