"""Exact top-k by inner product: a KD-tree per shard, searched best first.

Vectors are dealt into shards of bounded size. A shard's tree is split at the median of its widest dimension, with
tight bounding boxes; a box bounds the inner product with a query from above. A query visits boxes in the order of
their bounds and stops when no box can beat its k-th score. The k-th scores of a first shard start the search of the
next few, and those of all of these the search of the rest, so most of their boxes are never opened. Queries travel in
blocks, each block to each shard once, and every shard gives back at most k rows a query.

Defined results: vectors that are null or hold null or non-finite components take no part; an inner product is taken
between vectors of the same length only, so each length (0 too) is searched by itself; ties go to the smaller id;
repeated rows are candidates of their own, but no row with the query's own id is; of several rows of a length with a
query's id the smallest vector asks; scores beyond the range of a long stand at its end; a null id is no query and no
candidate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Rows of a shard, and queries of a block, that meet in one task: 64 components take 16 MB. Smaller tables are dealt
#: out to all cores, down to so many rows and queries.
SHARD_ROWS, LEAST_ROWS = 32_768, 4096
QUERY_ROWS, LEAST_QUERIES = 8192, 512
#: Shards after the first whose k-th scores are passed on to the rest.
SECOND_SHARDS = 7
#: Queries whose bounds are held at once.
BLOCK_ROWS = 1024
LEAF = 256
RESULT = "query_id long, width int, vec_id long, score long"


class KDTree:
    """Nodes are boxes over a run of rows; children of node i are in left[i] and right[i], or -1."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(points))
        self.span, self.left, self.right, low, high = [], [], [], [], []
        todo = [(0, len(points), -1, False)]
        while todo:
            a, b, parent, second = todo.pop()
            node = len(self.span)
            if parent >= 0:
                (self.right if second else self.left)[parent] = node
            own = points[order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            self.span.append((a, b))
            self.left.append(-1)
            self.right.append(-1)
            low.append(lo)
            high.append(hi)
            if b - a > leaf and (hi > lo).any():
                m = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, int(np.argmax(hi - lo))], m)]
                todo += [(a + m, b, node, True), (a, a + m, node, False)]
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the highest inner product that a point of the box can have."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bound: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, -id) of at least floor, best first."""
        best: list[tuple[int, int]] = []
        heap = [(-bound[0], 0)]
        while heap:
            upper, node = heapq.heappop(heap)
            least = max(x for x in (floor, best[0][0] if len(best) == k else None) if x is not None) if floor is not None or len(best) == k else None
            if least is not None and -upper < least:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.span[node]
            scores = self.points[a:b] @ query
            for i in np.flatnonzero(scores >= least) if least is not None else range(b - a):
                if (x := (int(scores[i]), -int(self.ids[a + i])))[1] != -own:
                    if len(best) < k:
                        heapq.heappush(best, x)
                    elif x > best[0]:
                        heapq.heapreplace(best, x)
        return sorted(best, reverse=True)


def _exact(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As doubles where all sums are exact in them, else as whole numbers of any size."""
    most = max((float(np.abs(x).max()) if x.size else 0.0) for x in (points, queries))
    if most * most * max(1, points.shape[1]) < 2**53:
        return points, queries
    whole = np.vectorize(int, otypes=[object])
    return whole(points), whole(queries)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _searcher(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if shard.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "width": [], "vec_id": [], "score": []}).astype("int64")
        points, wanted = _exact(_matrix(shard["vector"]), _matrix(queries["wanted"]))
        tree = KDTree(points, shard["vec_id"].to_numpy(np.int64))
        out = []
        for i in range(0, len(queries), BLOCK_ROWS):
            bounds = tree.bounds(wanted[i : i + BLOCK_ROWS])
            for q, bound, own, floor in zip(wanted[i : i + BLOCK_ROWS], bounds, queries["query_id"].iloc[i : i + BLOCK_ROWS], queries["floor"].iloc[i : i + BLOCK_ROWS], strict=True):
                found = tree.search(q, bound, int(own), k, None if pd.isna(floor) else int(floor))
                out += [(int(own), points.shape[1], -x, s) for s, x in found]
        done = pd.DataFrame(out, columns=["query_id", "width", "vec_id", "score"])
        done["score"] = [min(max(s, -(2**63)), 2**63 - 1) for s in done["score"]]
        return done.astype("int64")

    return search


def whole_vectors(vectors: DataFrame, *, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id, vector: floor(scale * x) of each component, as doubles; only vectors that take part."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform(x, lambda c: c.cast("double") * F.lit(float(scale)))
    # floor() gives a long; from 2^52 on a double is whole as it is.
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("vector"))


def top_k(vectors: DataFrame, queries: Column, *, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that queries (over vec_id) is true of, the k highest inner products with other rows."""
    whole = settle(whole_vectors(vectors, id_col=id_col, vector_col=vector_col, scale=scale).withColumn("width", F.size("vector")), "vectors")
    cores = whole.sparkSession.sparkContext.defaultParallelism
    asked = whole.where(queries).groupBy("vec_id", "width").agg(F.min("vector").alias("wanted")).withColumnRenamed("vec_id", "query_id")
    rows, wanted = whole.count(), asked.count()
    shards = max(1, -(-rows // SHARD_ROWS), min(cores, rows // LEAST_ROWS))
    blocks = max(1, -(-wanted // QUERY_ROWS), min(cores, wanted // LEAST_QUERIES))
    dealt = whole.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    search = _searcher(k)

    def through(floors: DataFrame, first: int, last: int) -> DataFrame:
        sent = floors.select("query_id", "wanted", "floor", F.col("block").alias("block"), F.col("width").alias("width"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("shard"))
        own = dealt.where(F.col("shard").between(first, last)).select("vec_id", "vector", "width", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        met = own.groupBy("shard", "block", "width").cogroup(sent.groupBy("shard", "block", "width"))
        return met.applyInPandas(lambda a, b: search(a, b), RESULT)

    best = Window.partitionBy("query_id", "width").orderBy(F.desc("score"), "vec_id")
    found = None
    for first, last in ((0, 0), (1, min(SECOND_SHARDS, shards - 1)), (SECOND_SHARDS + 1, shards - 1)):
        if first > last:
            break
        floors = asked.withColumn("floor", F.lit(None).cast("long"))
        if found is not None:
            kth = found.groupBy("query_id", "width").agg(F.when((F.count("*") == k) & (F.abs(F.min("score")) < 2**53), F.min("score")).alias("floor"))
            floors = asked.join(kth, ["query_id", "width"], "left")
        new = through(floors, first, last)
        every = new if found is None else found.unionByName(new)
        found = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
        found = settle(found, "found") if last < shards - 1 else found
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
