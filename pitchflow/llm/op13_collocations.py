"""Collocations: phrases of two to LONGEST words that stand together more often than their parts suggest.

Counting goes over a prefix-free parse. A text is a row of words, with a dot where a piece ends (at marks and line ends).
It is cut before every trigger, a word that hashes with the one before to a multiple of WINDOW; where a trigger is long in
coming, every FAR-th word after the last is cut too, so chunks are of bounded length. A chunk carries the LONGEST - 1
words that follow its own, so every phrase that starts among its own words lies inside it, and in no other chunk counts as
its own: overlaps are assigned once. Equal text is cut equally, so a dictionary of distinct chunks with their frequencies
is all that is counted from here on.

Phrases are counted level by level inside the distinct chunks, weighted by their frequencies. A phrase of k words can
only be frequent where both phrases of k - 1 words in it are; those are marked in a bit table of fixed most size, which
tasks ask before they emit anything. Pairs, which words alone hardly narrow down, are counted by hash first, so that
only their hashes are shuffled. The table may let a rare phrase through, which is then counted exactly and dropped, and
never loses one. So only phrases that may be frequent are shuffled, pre-aggregated.

Cases: null and empty texts have no pieces; a null lang is `und`, as is one of that name; other letters than A-Z keep
their case; copies and repeated rows count each time; very long texts and pieces are parsed whole, in memory of a small
multiple of their size; phrases of equal score and count are in the order of their bytes; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchflow.llm.common import stored, table

LONGEST, LEAST, TOP = 5, 100, 2000
WINDOW, FAR = 32, 128
#: Bits of the hashes by which phrases are told apart before they are counted.
HASH_BITS = 40
#: Bits of the table for each frequent phrase, and log2 of its most bits (16 MB).
BITS_EACH, MOST_BITS = 16, 27
#: Characters that a task parses at once, about.
_AT_ONCE = 8_000_000
_MARKS = r"[.,;:!?\n\x0b\x0c\r]"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words.to_pandas(), dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def _join_hash(first: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all but its last word, and its last word's."""
    x = (first ^ (first >> np.uint64(29))) * _MIX + more
    return x ^ (x >> np.uint64(32))


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of bounded text, a longer text by itself."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        part = size // _AT_ONCE
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def cuts(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the words before which texts are cut: their first words, triggers, and every FAR-th word from those."""
    pair = _join_hash(np.concatenate([hashes[:1], hashes[:-1]]), hashes)
    edge = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (pair % np.uint64(WINDOW) == 0))
    room = np.diff(edge, append=len(text))
    more = -(-room // FAR)
    return np.repeat(edge, more) + FAR * _ranges(np.zeros(len(more), dtype=np.int64), more)


def parse(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The text, the words (own and following, space-joined) and the number of own ones, and of those that aren't dots, of
    every chunk."""
    dotted = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), _MARKS, " . ")
    split = pc.split_pattern_regex(dotted, r"[ \t]+")
    text = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
    coded = split.flatten().dictionary_encode()
    place = lambda word: (pc.index(coded.dictionary, word).as_py())
    code, nothing, dot = coded.indices.to_numpy(), place(""), place(".")
    real = code != nothing
    # a dot stands between words only, and once
    code, text = code[real], text[real]
    again = (code == dot) & ((np.diff(text, prepend=-1) != 0) | (np.concatenate([[-1], code[:-1]]) == dot))
    code, text = code[~again], text[~again]
    if not len(code):
        none = np.zeros(0, np.int64)
        return none, pa.array([], pa.string()), none, none
    start = cuts(_word_hash(coded.dictionary)[code], text)
    own = np.diff(start, append=len(text))
    size = np.minimum(own + LONGEST - 1, np.searchsorted(text, text[start], side="right") - start)
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    chunks = pc.binary_join(pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(code[_ranges(start, size)]))), " ")
    return text[start], chunks, own, np.add.reduceat((code != dot).astype(np.int64), start)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, "text"):
        text, chunks, own, words = parse(batch.column("text"))
        found = pa.table({"lang": batch.column("lang").take(pa.array(text)), "chunk": chunks, "own": pa.array(own, pa.int32()), "words": pa.array(words, pa.int32())})
        keys = ["lang", "chunk", "own", "words"]
        yield from found.group_by(keys, use_threads=False).aggregate([([], "count_all")]).rename_columns([*keys, "n"]).cast(_CHUNK).combine_chunks().to_batches()


_CHUNK = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("own", pa.int32()), ("words", pa.int32()), ("n", pa.int64())])


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, own, words, n): the distinct chunks of docs(lang, text), how many words are their own, with and
    without dots, and how often they come."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    chunks = rows.mapInArrow(_chunks, "lang string, chunk string, own int, words int, n long")
    return stored(chunks.groupBy("lang", "chunk", "own", "words").agg(F.sum("n").alias("n")), "chunks")


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a hash of HASH_BITS bits in a table."""
    return (hashes * _MIX) >> np.uint64(64 - bits)


class Marks:
    """A bit for each hash of a frequent phrase of so many words."""

    def __init__(self, words_each: int, bits: int, words: np.ndarray):
        self.words_each, self.bits, self.words = words_each, bits, words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = _place(hashes >> np.uint64(64 - HASH_BITS), self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def phrase_hashes(flat: pa.Array, batch: pa.RecordBatch, longest: int) -> list[np.ndarray]:
    """For k = 1 .. longest, the hash of the phrase of k words at each word (flat) of a batch's chunks; it is of use where
    the chunk still has k words. Phrases of different languages differ."""
    coded, spoken = flat.dictionary_encode(), batch.column("lang").dictionary_encode()
    sizes = pc.add(pc.count_substring(batch.column("chunk"), " "), 1).to_numpy()
    own = _word_hash(coded.dictionary)[coded.indices.to_numpy()]
    seed = np.repeat(_word_hash(spoken.dictionary)[spoken.indices.to_numpy()], sizes)
    out = [_join_hash(seed, own)]
    for k in range(1, longest):
        out.append(_join_hash(out[-1], np.concatenate([own[k:], np.zeros(min(k, len(own)), np.uint64)])))
    return out


def _starts(batch: pa.RecordBatch, k: int, known: Marks | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a batch of the dictionary, and where phrases of k words start that may be frequent, with their chunks.
    Phrases start among a chunk's own words, end in the chunk and hold no dot."""
    words = pc.split_pattern(batch.column("chunk"), " ")
    sizes, own = pc.list_value_length(words).to_numpy().astype(np.int64), batch.column("own").to_numpy()
    starts_in = np.maximum(np.minimum(own, sizes - k + 1), 0)
    start, owner = _ranges(np.cumsum(sizes) - sizes, starts_in), np.repeat(np.arange(len(sizes)), starts_in)
    flat = words.flatten()
    dots = np.concatenate([[0], np.cumsum(pc.equal(flat, ".").to_numpy(zero_copy_only=False))])
    whole = dots[start + k] == dots[start]
    return flat, start[whole], owner[whole]


def _count(k: int, marks, by_hash: bool = False):
    """Phrases of k words that may be frequent, pre-aggregated, of the dictionary's chunks; by_hash: their hashes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = marks.value if marks else []
        for batch in _slices(batches, "chunk"):
            flat, start, owner = _starts(batch, k, known)
            hashes = phrase_hashes(flat, batch, k) if known else []
            for table_ in known:
                of = hashes[table_.words_each - 1]
                may = np.ones(len(start), dtype=bool)
                for j in range(k - table_.words_each + 1):
                    may &= table_.has(of[start + j])
                start, owner = start[may], owner[may]
            if not len(start):
                continue
            n = batch.column("n").take(pa.array(owner))
            if by_hash:
                found = pa.table({"hash": pa.array((hashes[-1][start] >> np.uint64(64 - HASH_BITS)).astype(np.int64)), "n": n})
            else:
                parts = [flat.take(pa.array(start + j)) for j in range(k)]
                found = pa.table({"lang": batch.column("lang").take(pa.array(owner)), "phrase": parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " "), "n": n})
            names = found.column_names
            yield from found.group_by(names[:-1], use_threads=False).aggregate([("n", "sum")]).rename_columns(names).cast(pa.schema([(c, pa.int64() if c in ("n", "hash") else pa.string()) for c in names])).combine_chunks().to_batches()

    return run


def _bits_of(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    at = np.unique(_place(hashes, bits))
    word = (at >> np.uint64(6)).astype(np.int64)
    begins = np.flatnonzero(np.diff(word, prepend=-1))
    ones = np.left_shift(np.uint64(1), at & np.uint64(63))
    return pa.RecordBatch.from_arrays([pa.array(word[begins]), pa.array(np.bitwise_or.reduceat(ones, begins).view(np.int64))], ["word", "bits"])


def _marked(bits: int):
    """The words of the bit table that a batch of frequent phrases, or of their hashes, sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if "hash" in batch.schema.names:
                yield _bits_of(batch.column("hash").to_numpy().astype(np.uint64), bits)
                continue
            words = pc.split_pattern(batch.column("phrase"), " ")
            sizes = pc.list_value_length(words).to_numpy().astype(np.int64)
            one = pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("phrase")], ["lang", "chunk"])
            yield _bits_of(phrase_hashes(words.flatten(), one, int(sizes[0]))[-1][np.cumsum(sizes) - sizes] >> np.uint64(64 - HASH_BITS), bits)

    return run


def marks(frequent: DataFrame, words_each: int) -> Marks:
    """The bit table of frequent(lang, phrase, ...) or (hash, ...), phrases of so many words: at most 2^MOST_BITS bits,
    however many there are."""
    bits = min(MOST_BITS, max(10, int(BITS_EACH * frequent.count()).bit_length()))
    asked = frequent.select(*[c for c in ("hash", "lang", "phrase") if c in frequent.columns])
    found = asked.mapInArrow(_marked(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table_ = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for row in found.toArrow().to_batches():
        table_[row.column("word").to_numpy()] = row.column("bits").to_numpy().view(np.uint64)
    return Marks(words_each, bits, table_)


def frequent_phrases(chunks: DataFrame, longest: int = LONGEST, least: int = LEAST) -> list[DataFrame]:
    """For k = 1 .. longest: (lang, phrase, n) of the phrases of k words that come at least so often."""
    sc = chunks.sparkSession.sparkContext
    out: list[DataFrame] = []
    for k in range(1, longest + 1):
        known = [marks(out[-1], k - 1)] if out else []
        if k == 2:
            hashed = chunks.mapInArrow(_count(k, sc.broadcast(known), by_hash=True), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
            known = [marks(stored(hashed.filter(F.col("n") >= least).select("hash"), "pairs"), k)]
        grams = chunks.mapInArrow(_count(k, sc.broadcast(known)), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        out.append(stored(grams.filter(F.col("n") >= least), f"phrases-{k}"))
    return out


def _parts(phrases: DataFrame, least: int, most) -> DataFrame:
    """phrases with every contiguous part (part) of least to most(words) words."""
    k = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(least), most), lambda m: F.transform(F.sequence(F.lit(1), k - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    return phrases.select("lang", "a", F.explode(F.array_distinct(spans)).alias("part"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language."""
    chunks = dictionary(docs)
    total = chunks.groupBy("lang").agg(F.sum(F.col("words") * F.col("n")).alias("n"))
    levels = frequent_phrases(chunks, longest, least)
    counted = reduce(DataFrame.unionByName, levels).withColumnRenamed("n", "a")
    phrases = reduce(DataFrame.unionByName, levels[1:]).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    longer = _parts(phrases.filter(F.size("words") > 2), 2, F.size("words") - 1).groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("inside"))
    own = phrases.join(longer, ["lang", "phrase"], "left").filter("inside is null or 100 * inside < 100 * a")
    cut = own.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("first"), F.array_join(F.slice("words", k + 1, F.size("words")), " ").alias("rest")))).alias("c"))
    side = lambda name, value: counted.select("lang", F.col("phrase").alias(name), F.col("a").alias(value))
    both = cut.select("lang", "phrase", "a", "c.*").join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(total, "lang")
    # 1000 * a * n stays below 10^38 up to 10^15 occurrences of 10^19 words; l and r are at least a, so scores are longs
    score = F.expr("(CAST(1000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    scored = scored.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a part of each language first, so that no task ranks a whole one
    some = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op13_phrase_collocations": op13_phrase_collocations}
ORACLE = {
    "op13_phrase_collocations": r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k) r WHERE len(ws) >= k),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
    t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
    c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
    inside AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS inside FROM (SELECT lang, a, k, ws, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c) t) t GROUP BY ALL),
    own AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE inside IS NULL OR 100 * inside < 100 * a),
    cut AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM own) t),
    s AS (SELECT cut.lang, cut.phrase, cut.a, j, x.a AS l, y.a AS r, CAST(n AS BIGINT) AS n, CAST((1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest JOIN t ON t.lang = cut.lang),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000"""
}
