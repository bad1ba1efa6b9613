"""Removal of boilerplate lines by the number of distinct sites that carry them.

Lines of at least MIN_WORDS words are hashed (without white space at their ends). A HyperLogLog sketch of the sites of
each hash merges by aggregation. Lines whose estimate is clearly above MIN_SITES are boilerplate; for those near it the
sites are counted exactly. Boilerplate stays in one document, the one with the smallest id that has it, and goes from
all others. Only hashes and ids are shuffled until the documents meet the hashes that each of them loses.

Shorter lines are left alone by the query, as its SQL has it. With short_share (the pipeline's stage) every line that
isn't blank is counted, and one of fewer words is boilerplate where it stands on that share of all sites, MIN_SITES at
least.

Cases: null text stays null, empty text stays empty; blank lines are never touched; a null source is a site of its
own; rows with a null doc_id count as carriers but keep their lines; rows that share a doc_id are one document; a
document may lose all of its lines and stays with empty text; other columns are kept, whatever their names, and n_chars
is counted anew; an empty table gives no rows. A text of any length is read whole, as one array of its lines in a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm.common import WORD, stored, table, unused

MIN_SITES = 5
MIN_WORDS = 5
#: Shares of MIN_SITES between which an estimate is checked; several times the sketch's error.
NEAR = (0.8, 1.2)
#: Share of all sites that makes a line of fewer than MIN_WORDS words boilerplate in the pipeline.
SHORT_SHARE = 0.5
LG_K = 10
SALTS = 16


def line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def site(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, site, key, short) of every line that is long enough; short ones have fewer than MIN_WORDS words."""
    split = docs.filter("text is not null").select(F.col("doc_id"), site(F.col("source")).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    words = F.regexp_count("line", F.lit(WORD))
    return split.filter(words >= min_words).select("doc_id", "site", line_key(F.col("line")).alias("key"), (words < MIN_WORDS).alias("short"))


def boilerplate(found: DataFrame, sites: DataFrame, min_sites: int = MIN_SITES, short_share: float | None = None) -> DataFrame:
    """(key, keeper) of the lines in found that at least min_sites sites carry; with short_share, of short ones on that
    share of all sites (site) too."""
    least, short = F.lit(min_sites), []
    if short_share is not None:
        short = [F.max("short").alias("short")]
        least = F.when(F.col("short"), max(min_sites, math.ceil(short_share * sites.distinct().count()))).otherwise(min_sites)
    sketched = found.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("doc_id").alias("keeper"), *short)
    sized = sketched.select("key", "keeper", F.hll_sketch_estimate("sketch").alias("sites"), least.alias("least")).filter(F.col("sites") >= NEAR[0] * F.col("least"))
    near = sized.filter(F.col("sites") <= NEAR[1] * F.col("least"))
    exact = found.select("key", "site").distinct().join(near.select("key", "keeper", "least"), "key")
    exact = exact.groupBy("key", "keeper", "least").agg(F.count("*").alias("sites")).filter(F.col("sites") >= F.col("least"))
    return sized.filter(F.col("sites") > NEAR[1] * F.col("least")).select("key", "keeper").unionByName(exact.select("key", "keeper"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, short_share: float | None = None, counts: bool = True) -> DataFrame:
    """docs with the texts that remain; with counts, also columns n_lines and n_removed, in place of any of these names.

    Every line's hash is written once. What documents lose meets them by a hash join on both sides' ids, at every size."""
    min_words = MIN_WORDS if short_share is None else 1
    found = stored(lines(docs, min_words), "line-keys")
    # a line may stand in any share of all documents: its key meets them in SALTS parts
    parted = boilerplate(found, docs.select(site(F.col("source")).alias("site")), min_sites, short_share).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = found.select("doc_id", "key").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    lost = own.join(parted, ["key", "salt"]).filter("doc_id <> keeper")
    u = unused(docs)
    gone = lost.groupBy(F.col("doc_id").alias(f"{u}doc")).agg(F.collect_set("key").alias(f"{u}gone"))
    every, lost_here = F.split("text", "\n"), F.col(f"{u}gone")
    stays = lambda x: ~(F.array_contains(lost_here, line_key(x)) & (F.regexp_count(x, F.lit(WORD)) >= min_words))
    out = docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(f"{u}doc"), "left").withColumn(f"{u}kept", F.when(lost_here.isNotNull(), F.filter(every, stays)))
    new = {"text": F.when(lost_here.isNull(), F.col("text")).otherwise(F.array_join(f"{u}kept", "\n"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost_here.isNull(), F.col("n_chars")).otherwise(F.length(new["text"])).cast(docs.schema["n_chars"].dataType)
    n_lines = F.coalesce(F.size(F.when(F.col("text").isNotNull(), every)), F.lit(0))
    more = {"n_lines": F.greatest(n_lines, F.lit(0)), "n_removed": F.when(lost_here.isNull(), 0).otherwise(n_lines - F.size(f"{u}kept"))} if counts else {}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns if c not in more], *[c.alias(name) for name, c in more.items()])


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return remove_boilerplate(docs).select("doc_id", "text", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"))


QUERIES = {"op7_line_spread": op7_line_spread}
ORACLE = {
    "op7_line_spread": r"""
    WITH parts AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, coalesce('s' || source, 'n') AS site, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM parts),
    k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 5 AS long FROM l),
    b AS (SELECT key, min(doc_id) AS keeper FROM k WHERE long GROUP BY key HAVING count(DISTINCT site) >= 5),
    m AS (SELECT k.doc_id, k.line, k.pos, NOT (k.long AND b.key IS NOT NULL AND k.doc_id <> b.keeper) AS stays FROM k LEFT JOIN b ON k.key = b.key AND k.long)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE NOT stays) AS BIGINT) AS n_removed FROM m GROUP BY doc_id"""
}
