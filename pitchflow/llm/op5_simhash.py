"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint fall into three blocks of 22, 21 and 21 bits. Two fingerprints that differ in at most
four bits differ in at most one bit of some block. The anchors of a block are the 4096 words of the perfect binary
Golay code (23, 12): every block value has exactly one anchor within the covering radius 3, its home, and about five
within 3 + 1. A fingerprint is replicated to every anchor within 4, and each anchor compares the fingerprints at home
there with all that visit it, so that no pair within the threshold is missed.

Copies share a fingerprint and are folded before anything is replicated. An anchor with many fingerprints is cut into
square blocks of bounded size, all of which are compared, and each block returns a spanning forest of its links rather
than its pairs. Components then form by alternating large-star and small-star steps on checkpointed edges.

Cases: null or empty text, or one without words, has fingerprint zero and links like any other; fewer than four words
give one shingle, the whole sequence; repeated rows are kept and share a component; a null doc_id is kept with its
fingerprint and takes no part in choosing the smallest id (its component is null only if no id is known there); an empty
table gives no rows; other columns, whatever their names, are not read. A text of any length is read whole; a worker
holds a hash for each of its words, about eight times a long text's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm.common import cut, held, stored, table

SHINGLE = 4
THRESHOLD = 4
SEED = 42
#: (shift, width) of the blocks of a fingerprint.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code, from its definition.
GOLAY = 0b110001110101
RADIUS = 3
#: Most fingerprints at one side of a comparison task.
SIDE = 2048


def simhash(text: bytes) -> int:
    words = text.lower().split()  # both know ASCII only
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(flat, SEED)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(flat[a:b], SEED) for a, b in zip((ends - sizes).tolist(), ends[SHINGLE - 1 :].tolist())]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("simhash", tuple)
    for batch in batches:
        fp = np.fromiter((simhash(t.as_py() or b"") for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


@cache
def _anchors() -> tuple[np.ndarray, np.ndarray]:
    """Error patterns up to RADIUS + 1 by syndrome: all of them padded with -1, the lightest first."""
    patterns = np.array([sum(1 << b for b in c) for w in range(RADIUS + 2) for c in combinations(range(23), w)], dtype=np.int64)
    by: list[list[int]] = [[] for _ in range(2048)]
    for p, s in zip(patterns.tolist(), _syndrome(patterns).tolist()):
        by[s].append(p)
    width = max(map(len, by))
    return np.array([x + [-1] * (width - len(x)) for x in by], dtype=np.int64), np.array([len(x) for x in by])


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit polynomial modulo the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GOLAY << (bit - 11), 0)
    return rest


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists, counts = _anchors()
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        node = batch.column("node").to_numpy(zero_copy_only=False)
        for block, (shift, width) in enumerate(BLOCKS):
            value = ((fp.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
            s = _syndrome(value)
            errors, live = lists[s], np.arange(lists.shape[1]) < counts[s][:, None]
            row, slot = np.nonzero(live)
            anchor = (value[row] ^ errors[row, slot]) >> 11  # the information bits name the code word
            home = slot == 0
            yield pa.RecordBatch.from_arrays([pa.array((anchor + (block << 12)).astype(np.int32)), pa.array(home), pa.array(fp[row]), pa.array(node[row])], ["anchor", "home", "fp", "node"])


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each node's component in a small graph."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    at_home, visits = group["home_side"].to_numpy(), ~group["home_side"].to_numpy()
    nodes, index = np.unique(group["node"].to_numpy(), return_inverse=True)
    fps = group["fp"].to_numpy().view(np.uint64)
    a, ia, b, ib = fps[at_home], index[at_home], fps[visits], index[visits]
    left, right = [], []
    step = max(1, (1 << 22) // max(1, len(b)))
    for k in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= THRESHOLD)
        keep = ia[k + x] != ib[y]
        left.append(ia[k + x[keep]])
        right.append(ib[y[keep]])
    if not left or not sum(map(len, left)):
        return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
    root = _forest(np.concatenate(left), np.concatenate(right), len(nodes))
    leaf = np.nonzero(root != np.arange(len(nodes)))[0]
    return pd.DataFrame({"u": nodes[leaf], "v": nodes[root[leaf]]})


def links(nodes: DataFrame, side: int = SIDE) -> DataFrame:
    """Edges (u > v) between node ids, a spanning forest of the links found at each anchor. nodes: (fp, node)."""
    spread = nodes.mapInArrow(_replicate, "anchor int, home boolean, fp long, node long")
    # at most 3 * 4096 anchors exist, whatever the input
    sizes = spread.groupBy("anchor").agg(F.sum(F.col("home").cast("int")).alias("nh"), F.count("*").alias("nv")).select("anchor", F.ceil(F.col("nh") / side).cast("int").alias("hs"), F.ceil(F.col("nv") / side).cast("int").alias("vs")).filter("hs > 0")
    rows = spread.join(F.broadcast(sizes), "anchor")
    part = F.xxhash64("fp")
    visit = rows.select("anchor", F.explode(F.expr("sequence(0, hs - 1)")).alias("i"), F.pmod(part, "vs").cast("int").alias("j"), F.lit(False).alias("home_side"), "fp", "node")
    home = rows.filter("home").select("anchor", F.pmod(part, "hs").cast("int").alias("i"), F.explode(F.expr("sequence(0, vs - 1)")).alias("j"), F.lit(True).alias("home_side"), "fp", "node")
    return home.unionByName(visit).groupBy("anchor", "i", "j").applyInPandas(_compare, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable. edges: (u, v)."""
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = sign(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = sign(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, side: int = SIDE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    fps = cut(fingerprints(docs))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = components(links(nodes.filter("node is not null"), side))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, side: int = SIDE) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest doc_id.

    Repeated rows of that document collapse into one as well; rows without a doc_id stay. What goes is written first,
    so that its size is known when it meets the texts: these are only shuffled where it is too large to broadcast."""
    found = near_duplicates(docs.select("doc_id", "text"), side).filter("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.min("component_id").alias("root"), F.count("*").alias("n"))
    out = stored(ids.filter("doc_id <> root or n > 1").select("doc_id", (F.col("doc_id") == F.col("root")).alias("repeated")), "near-duplicates")
    once = docs.join(out.select("doc_id"), "doc_id", "left_anti")
    repeated = docs.join(out.filter("repeated").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.select(docs.columns).unionByName(repeated.select(docs.columns))


def op5_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash_anchor": op5_simhash_anchor}
ORACLE: dict[str, str] = {}
