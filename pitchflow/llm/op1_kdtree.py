"""Exact top-k inner-product search with a KD-tree for each shard.

Vectors are dealt to shards of about SHARD rows by a hash of their id. A shard's task builds a KD-tree (median splits
along the widest side, tight bounding boxes) and answers its queries best-first: nodes in order of the largest inner
product that a point of their box could have with the query, until that bound falls below the query's k-th score so
far. Each query first visits the shard it lives in; the k-th score found there travels with it to every other shard
and prunes from the first node on. Queries come in groups of bounded size; the k best of all shards are merged.

Cases: a vector that is null, empty, or holds a null or non-finite component takes no part, nor does a null id; a
query meets only vectors with as many components; repeated rows count once, and of different vectors under one id the
smallest counts (as arrays compare); equal scores rank the smaller id first; fewer than k candidates give all of them; an
empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchflow.llm.common import cut, table

K = 5
EVERY = 50
SHARD = 4096
LEAF = 64
#: Queries that one task holds at a time.
GROUP = 16384


def scaled(vector: Column) -> Column:
    """floor(256 x) of each component as a long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class KdTree:
    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        self.first, self.end, self.left, low, high = [], [], [], [], []
        waiting = deque([(0, len(ids))])
        made = 1
        while waiting:  # nodes are numbered in the order in which they are made; a node's children stand side by side
            a, b = waiting.popleft()
            own = points[order[a:b]]
            low.append(own.min(axis=0)), high.append(own.max(axis=0))
            self.first.append(a), self.end.append(b)
            wide = int(np.argmax(high[-1] - low[-1]))
            if b - a <= LEAF or low[-1][wide] == high[-1][wide]:
                self.left.append(-1)
                continue
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, wide], middle)]
            self.left.append(made)
            made += 2
            waiting += [(a, a + middle), (a + middle, b)]
        self.ids, self.points, self.low, self.high = ids[order], points[order], np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bound: np.ndarray, kth: float, k: int) -> list[tuple[int, int]]:
        """Up to k best (score, id); those below kth may be left out."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        heap = [(-bound[0], 0)]
        while heap:
            most, node = heapq.heappop(heap)
            if -most < kth:
                break
            child = self.left[node]
            if child >= 0:
                for c in (child, child + 1):
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = self.first[node], self.end[node]
            scores = self.points[a:b] @ query
            for i in np.nonzero(scores >= kth)[0]:
                if (vec_id := int(self.ids[a + i])) != query_id:
                    item = (int(scores[i]), -vec_id)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    if len(best) == k and best[0][0] > kth:
                        kth = best[0][0]
        return [(s, -i) for s, i in best]


def _unique(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, one of each id, in order of id."""
    ids, points = rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy())
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*points.T[::-1], ids))
        ids, points = ids[order], points[order]
        keep = np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, points = ids[keep], points[keep]
    return ids, points


def _answer(k: int):
    def answer(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(points) and len(queries):
            ids, vectors = _unique(points)
            query_ids, wanted = _unique(queries)
            kth = queries.groupby("vec_id")["kth"].max().loc[query_ids].fillna(float("-inf")).to_numpy()
            # floating point is exact up to 2^53; beyond, whole numbers of 64 bits
            exact = float(np.abs(vectors.astype(float)).max()) * float(np.abs(wanted.astype(float)).max()) * vectors.shape[1] < 2.0**52
            kind = np.float64 if exact else np.int64
            tree, wanted = KdTree(ids, vectors.astype(kind)), wanted.astype(kind)
            for start in range(0, len(wanted), 1024):
                bounds = tree.bounds(wanted[start : start + 1024])
                for i in range(len(bounds)):
                    q = start + i
                    out += [(int(query_ids[q]), vec_id, score) for score, vec_id in tree.search(int(query_ids[q]), wanted[q], bounds[i], kth[q], k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return answer


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score). vectors, queries: (vec_id, vector array<long>), queries out of vectors."""
    shards = max(1, -(-vectors.count() // shard))
    groups = max(1, -(-queries.count() // group))
    schema, keys = "query_id long, vec_id long, score long", ("dim", "shard", "part")
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")
    placed = vectors.select("vec_id", "vector", F.size("vector").alias("dim"), deal.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    asked = queries.select(F.col("vec_id").alias("vec_id"), F.col("vector").alias("vector"), F.size("vector").alias("dim"), deal.alias("home"), part.alias("part"))

    def visit(questions: DataFrame) -> DataFrame:
        return placed.groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInPandas(_answer(k), schema)

    home = cut(visit(asked.withColumnRenamed("home", "shard").withColumn("kth", F.lit(None).cast("double"))))
    if shards == 1:
        return _best(home, k)
    kth = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
    away = asked.join(kth, asked.vec_id == kth.query_id, "left").drop("query_id")
    away = away.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home").drop("home")
    return _best(home.unionByName(visit(away)), k)


def op1_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = rows.select(F.col("vec_id").cast("long"), scaled(F.col("embedding")).alias("vector"))
    found = top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
    return found.select("query_id", "rank", "vec_id", "score")


QUERIES = {"op1_kdtree_topk": op1_kdtree_topk}
ORACLE = {
    "op1_kdtree_topk": """
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
