"""Licence detection by ordered signature rules over the words of whole texts.

A text becomes its words in lower case with one space between them. The rules (license_rules.py, several hundred) are
gated by keywords: only those run whose keyword is a word of the text. A match is an interval of words. Of overlapping
intervals, one that lies inside another goes, if the other's tier is as strong or stronger; of equal intervals the
stronger tier stays, then the earlier rule. Denials ("not released under ...") take what they contain and carry no label.
Intervals are sorted by where they start, the longer first, so that an interval lies inside an earlier one exactly where
the largest end so far, among tiers as strong, reaches its own; these maxima come from a prefix scan in log2(n) steps.

All of this is one projection: nothing is shuffled, and each row stands for itself.

Cases: null and empty text have no words and no detections; other letters than A-Z keep their case; a phrase that occurs
several times counts each time, and its places stay in the base columns even where a longer detection takes them; very
long texts are read whole, in memory of a small multiple of their size; repeated rows are repeated; an empty table gives
no rows; other columns are kept by detect(), whatever their names, save `detections` and `n_words`, which it replaces.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm.common import let, table
from pitchflow.llm.license_rules import CONFIDENCE, Rule, rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\x01", "\x02"  # can't be part of a word
_RULE = "struct<pattern:string,label:string,tier:int,place:int,base:boolean>"
DETECTION = "array<struct<first:bigint,last:bigint,tier:int,place:int,label:string,base:boolean,kept:boolean>>"


def normal_words(text: Column) -> Column:
    """The words in lower case, with a space before, between and after them."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(low, _NO_WORD, " ")), F.lit(" "))


def gate(ordered: list[Rule]) -> tuple[Column, Column]:
    """The keywords, and the rules of each, as constants of the plan."""
    by_word: dict[str, list[dict]] = {}
    for place, r in enumerate(ordered):
        by_word.setdefault(r.keyword, []).append({"pattern": f"(?<= )(?:{r.pattern})(?= )", "label": r.label, "tier": r.tier, "place": place, "base": r.base})
    return F.array(*[F.lit(k) for k in by_word]), F.from_json(F.lit(json.dumps(by_word)), f"map<string,array<{_RULE}>>")


def _places(words: Column, test) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.when(test(w), i.cast("long")).otherwise(-1)), lambda i: i >= 0)


def intervals(text: Column, rule: Column) -> Column:
    """Where a rule matches: first and last word of each match."""
    marked = F.split(F.btrim(F.regexp_replace(text, rule["pattern"], F.lit(f"{_OPEN}$0{_CLOSE}"))), " ")
    ends = lambda words: F.zip_with(
        _places(words, lambda w: w.startswith(_OPEN)), _places(words, lambda w: w.endswith(_CLOSE)),
        lambda first, last: F.struct(first.alias("first"), (-last).alias("to"), rule["tier"].alias("tier"), rule["place"].alias("place"), last.alias("last"), rule["label"].alias("label"), rule["base"].alias("base")))
    return let(marked, ends)


def running_max(values: Column) -> Column:
    """The largest value up to each place: a prefix scan that doubles its reach."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.aggregate(steps, values, lambda now, k: F.transform(now, lambda x, i: F.greatest(x, F.get(now, i - F.call_function("shiftleft", F.lit(1), k)))))


def resolve(found: Column) -> Column:
    """The intervals in order, each with whether it stays."""

    def judged(ordered: Column) -> Column:
        reach = F.transform(F.sequence(F.lit(0), F.lit(len(CONFIDENCE) - 1)), lambda t: running_max(F.transform(ordered, lambda x: F.when(x["tier"] <= t, x["last"]).otherwise(-1))))
        inside = lambda most, x, i: F.coalesce(F.get(F.get(most, x["tier"]), i - 1) >= x["last"], F.lit(False))
        return let(reach, lambda most: F.transform(ordered, lambda x, i: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["tier"].alias("tier"), x["place"].alias("place"), x["label"].alias("label"), x["base"].alias("base"), (~inside(most, x, i)).alias("kept"))))

    return let(F.array_sort(found), judged)


def detect(docs: DataFrame, ordered: list[Rule] | None = None) -> DataFrame:
    """docs(text, ...) with n_words and detections: all matches of the rules in the order of their places, each with its
    rule's place in the list, label and tier, and whether it stays (kept)."""
    keywords, by_word = gate(ordered or rules())
    none = F.array().cast(DETECTION)

    def scan(text: Column) -> Column:
        words = F.split(F.btrim(text), " ")
        n = F.when(F.length(text) > 2, F.size(words)).otherwise(0).cast("long")
        matching = lambda k: F.filter(by_word[k], lambda r: F.call_function("rlike", text, r["pattern"]))
        found = lambda present: F.flatten(F.transform(present, lambda k: F.flatten(F.transform(matching(k), lambda r: intervals(text, r)))))
        seen = let(F.array_intersect(keywords, words), lambda present: F.when(F.size(present) == 0, none).otherwise(let(found(present), lambda f: F.when(F.size(f) == 0, none).otherwise(resolve(f)))))
        return F.struct(n.alias("n_words"), seen.alias("detections"))

    own = [c for c in docs.columns if c.lower() not in ("n_words", "detections")]
    scanned = let(normal_words(F.col("text")), scan)
    return docs.select(*own, F.inline(F.array(scanned)))


def op12_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base, kept = F.filter("detections", lambda d: d["base"]), F.filter("detections", lambda d: d["kept"] & (d["label"] != ""))
    names = lambda d: F.transform(d, lambda x: x["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    trust = F.array(*[F.lit(c) for c in CONFIDENCE])
    starts = F.transform("base", lambda x: x["first"])
    return found.select("doc_id", "n_words", base.alias("base"), kept.alias("kept")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(names(F.col("base"))).alias("base_labels"), joined(F.concat(names(F.col("base")), names(F.col("kept")))).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda x: F.get(trust, x["tier"]))), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op12_license_rules": op12_license_rules}
ORACLE: dict[str, str] = {}
