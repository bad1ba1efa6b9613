"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target in words: its weight's share of all words, at most REPEATS times its own, the excess shared
by weight among the others. A source's target is whole passes over it and a remaining budget below one pass. Documents
are counted by exact length; per source, a bounded knapsack decides how many documents of each length fill the budget
(an even share of each length first, then dynamic programming over the few words left), and so many of each length are
chosen in the order of a seeded hash. Every document is taken as often as there are passes, and once more if chosen.

Documents of one source and length are dealt to 256 buckets by that hash; buckets are counted, taken whole up to the
one where the number is reached, and only within that one documents are ranked, so that no group is ordered as a whole.

Cases: null text has no words; documents without words are taken 0 times a word; a null source comes last in order;
repeated rows count each; ties in the hash go by doc_id; an empty table gives no rows; other columns are kept by
mixed_rows, whatever their names. Where only documents are left that are longer than what the budget lacks beyond four
times BUDGET, the longest that fit are taken first, and dynamic programming fills the rest. Of a text of any length only
its number of words is used.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchflow.llm.common import cut, n_words, table, unused

REPEATS = 3
SEED = 9
#: Words that dynamic programming is to fill.
BUDGET = 1 << 16


def fit_budget(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of counts items of each size to take, so that their sum comes as near below budget as it can."""
    total = sum(s * n for s, n in zip(sizes, counts))
    if budget >= total:
        return list(counts)
    if budget <= 0:
        return [0] * len(sizes)
    take = [n * budget // total for n in counts]
    rest = budget - sum(s * k for s, k in zip(sizes, take))
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: -sizes[i])
    for i in order:
        more = min(counts[i] - take[i], max(0, rest - BUDGET) // sizes[i])
        take[i] += more
        rest -= more * sizes[i]
    for i in order if rest > 4 * BUDGET else ():  # only very large items are left
        more = min(counts[i] - take[i], rest // sizes[i])
        take[i] += more
        rest -= more * sizes[i]
    reach, mask, steps = 1, (1 << (rest + 1)) - 1, []
    for i in order:  # bit v of reach: v words can be filled exactly
        left, chunk = min(counts[i] - take[i], rest // sizes[i]), 1
        while left > 0 and not reach >> rest & 1:
            chunk = min(chunk, left)
            steps.append((i, chunk, reach))
            reach |= reach << (chunk * sizes[i]) & mask
            left -= chunk
            chunk *= 2
    value = reach.bit_length() - 1
    for i, chunk, before in reversed(steps):
        if not before >> value & 1:
            take[i] += chunk
            value -= chunk * sizes[i]
    return take


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    target, size = float(group["target"].iloc[0]), int(group["source_size"].iloc[0])
    passes = min(REPEATS, int(target // size)) if size else 0
    budget = round(target - passes * size) if passes < REPEATS else 0
    sizes, counts = group["size"].tolist(), group["n"].tolist()
    take = fit_budget([int(s) for s in sizes], [int(n) for n in counts], int(budget))
    return pd.DataFrame({"sid": group["sid"], "size": group["size"], "source_size": group["source_size"], "target": target, "passes": passes, "take": take})


def source_key(source: Column) -> Column:
    """Text that tells null from any source."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame) -> DataFrame:
    """(sid, source_size, target). sizes: (sid, source_size), a row for each source.

    The common level of words for a unit of weight is the largest that any number of capped sources, in the order of
    their cap for a unit of weight, leaves for the rest."""
    by_name = Window.orderBy((F.col("sid") == "n").cast("int"), "sid")
    weighed = sizes.withColumn("w", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", REPEATS * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = weighed.withColumn("level", left / F.sum("w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = level.withColumn("level", F.max("level").over(everywhere))
    return level.select("sid", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, size, source_size, target, copies) of every row of docs."""
    hashed = F.xxhash64("doc_id", F.lit(SEED))
    rows = cut(docs.select(F.col("doc_id").cast("long"), source_key(F.col("source")).alias("sid"), n_words(F.col("text")).alias("size"), hashed.alias("h")))
    bucket = F.shiftrightunsigned("h", 56).cast("int")
    buckets = rows.groupBy("sid", "size", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    lengths = buckets.groupBy("sid", "size").agg(F.sum("n").alias("n"))
    aims = targets(lengths.groupBy("sid").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    fitted = lengths.join(aims, "sid").groupBy("sid").applyInPandas(_fit, "sid string, size long, source_size long, target double, passes long, take long")
    before = Window.partitionBy("sid", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shares = buckets.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(fitted, ["sid", "size"])
    shares = shares.select("sid", "size", "bucket", "source_size", "target", "passes", (F.col("take") - F.col("before")).alias("take"))
    place = F.row_number().over(Window.partitionBy("sid", "size", "bucket").orderBy("h", "doc_id"))
    placed = rows.withColumn("bucket", bucket).join(shares, ["sid", "size", "bucket"]).withColumn("place", place)
    return placed.select("doc_id", "sid", "size", "source_size", "target", (F.col("passes") + (F.col("place") <= F.col("take")).cast("long")).alias("copies"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    u = unused(docs)
    own = mix(docs).groupBy("doc_id", "sid", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    own = own.select(*[F.col(c).alias(f"{u}{c}") for c in own.columns])
    same = F.col("doc_id").eqNullSafe(F.col(f"{u}doc_id")) & (source_key(F.col("source")) == F.col(f"{u}sid")) & (n_words(F.col("text")) == F.col(f"{u}size"))
    # repeated rows of a document share its copies
    place = F.row_number().over(Window.partitionBy(f"{u}doc_id", f"{u}sid", f"{u}size").orderBy(F.xxhash64("text")))
    rows = docs.join(own, same).withColumn(f"{u}place", place).withColumn(f"{u}share", F.expr(f"cast(({u}copies + {u}rows - {u}place) div {u}rows as int)"))
    return rows.filter(f"{u}share > 0").withColumn(f"{u}copy", F.explode(F.expr(f"sequence(1, {u}share)"))).select(docs.columns)


def op9_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op9_subset_sum_mix": op9_subset_sum_mix}
ORACLE: dict[str, str] = {}
