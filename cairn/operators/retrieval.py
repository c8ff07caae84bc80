"""Retrieval: signals ranked per query, fused by reciprocal rank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from .spatial import SPARE
from .staging import SMALL_ROWS, settle

#: The constant of reciprocal-rank fusion, candidates of a signal, and results of a query.
RRF_K = 60
POOL = 50
RESULTS = 8


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """The norms are given, since each vector meets many others."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.lit(1.0) - dot / (norm_a * norm_b)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, ranked from 1; Spark keeps only n rows a key and task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def unit(v: Column) -> Column:
    length = norm(v)
    return F.transform(v, lambda x: x / length)


#: Bytes of the query vectors that a broadcast of vector_top_k holds, and bytes and rows of a pack of vectors.
BLOCK_BYTES = 32 << 20
PACK_BYTES = 1 << 20
PACK_ROWS = 2048
#: Pairs of vectors that are scored at once, and what a distance may differ by when its products are added in another order.
SCORED = 1 << 20
ROUNDING = 1e-9


def _packed(rows: DataFrame, id_: str, name: str) -> DataFrame:
    """Rows of (id_, vector, norm), the vectors of one length, many to a row: {name}_id, {name}_flat, {name}_norm. They stay where they are."""
    kind = rows.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = min(PACK_ROWS, max(1, PACK_BYTES // (8 * len(batch.column(1)[at]))), batch.num_rows - at)
                own = batch.slice(at, n)
                columns = own.column(0), own.column(1).flatten(), own.column(2)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=[f"{name}_{x}" for x in ("id", "flat", "norm")])
                at += n

    return rows.select(id_, "vector", "norm").mapInArrow(run, f"{name}_id array<{kind}>, {name}_flat array<double>, {name}_norm array<double>")


def _nearest_in_packs(met: DataFrame, n: int, key: str, id_: str) -> DataFrame:
    """key, id_, distance of what may be among the n nearest of a query: packs of vectors (v) that each met packs of queries (q).

    A matrix product tells what is farther, by more than rounding, than n of the vectors that the task has seen; the
    distances of the rest are added up in the order of the components, as cosine_distance does.
    """
    kinds = [f"{c} {met.schema[f'{p}_id'].dataType.elementType.simpleString()}" for c, p in ((key, "q"), (id_, "v"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                ids, flat, norms, keys, asked, asked_norms = (batch.column(c)[k].values for c in ("v_id", "v_flat", "v_norm", "q_id", "q_flat", "q_norm"))
                v, q = (x.to_numpy().reshape(len(i), -1) for x, i in ((flat, ids), (asked, keys)))
                norm_v, norm_q = norms.to_numpy(), asked_norms.to_numpy()
                own = _firsts(v, ids.to_numpy(zero_copy_only=False), n)
                rough = 1.0 - (q @ v[own].T) / (norm_q[:, None] * norm_v[own])
                pack = q.tobytes()
                seen = np.concatenate([best[pack], rough], axis=1) if pack in best else rough
                best[pack] = np.partition(seen, n - 1, axis=1)[:, :n] if seen.shape[1] > n else seen
                bound = best[pack].max(axis=1) if best[pack].shape[1] == n else np.full(len(q), np.inf)
                at_q, at_v = np.nonzero(rough <= bound[:, None] + ROUNDING)
                at_v = own[at_v]
                columns_q, columns_v = np.ascontiguousarray(q.T), np.ascontiguousarray(v.T)
                for start in range(0, len(at_q), SCORED):
                    i, j = at_q[start : start + SCORED], at_v[start : start + SCORED]
                    dot = np.zeros(len(i))
                    for a, b in zip(columns_q, columns_v, strict=True):
                        dot += b[j] * a[i]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), ids.take(pa.array(j)), pa.array(1.0 - dot / (norm_v[j] * norm_q[i]))], names=[key, id_, "distance"])

    return met.mapInArrow(run, ", ".join([*kinds, "distance double"]))


def _firsts(v: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Rows without those that n equal ones of smaller ids stand before: these are never among the n nearest."""
    order = np.argsort(ids, kind="stable")
    alike = np.unique(np.ascontiguousarray(v[order]).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1]
    by_alike = np.argsort(alike, kind="stable")
    own = alike[by_alike]
    nth = np.arange(len(own)) - np.searchsorted(own, own)
    return order[by_alike[nth < n]]


def vector_top_k(queries: DataFrame, vectors: DataFrame, n: int = POOL, *, key: str = "query_id", id_: str = "place_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, id_, distance, rank: nearest by cosine.

    Queries are a stated set. They are broadcast, a block of block_bytes at a time, and held against each vector where it
    lies, pack by pack, so vectors are never shuffled, only n rows a query and task, and what drew near before n were
    seen; with several blocks vectors are read once a block. Vectors that no matrix holds (of another length, not finite,
    without length) are held against queries one by one.
    """
    sized = queries.where("vector is not null").select(key, "vector", norm(F.col("vector")).alias("norm"))
    size, dim = sized.agg(F.sum(8 * F.size("vector") + 24), F.max(F.size("vector"))).first()
    blocks = -(-(size or 0) // block_bytes)
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    regular = (F.size("vector") == F.lit(dim or 0)) & finite & F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False))
    asked = sized.withColumn("regular", regular)
    pairs = vectors.where("vector is not null").select(id_, "vector", norm(F.col("vector")).alias("norm")).withColumn("regular", regular)
    asked, pairs = (df.withColumn("vector", F.col("vector").cast("array<double>")) for df in (asked, pairs))
    odd = not all(df.where("not regular").isEmpty() for df in (asked, pairs))
    packs = _packed(pairs.where("regular"), id_, "v")
    distance = cosine_distance(F.col("vector"), F.col("asked"), F.col("norm"), F.col("asked_norm")).alias("distance")

    def met(own: DataFrame) -> DataFrame:
        near = _nearest_in_packs(packs.join(F.broadcast(_packed(own.where("regular").coalesce(1), key, "q")), F.lit(True)), n, key, id_)
        if not odd:
            return near
        each = own.select(key, F.col("vector").alias("asked"), F.col("norm").alias("asked_norm"), F.col("regular").alias("asked_regular"))
        plain = pairs.join(F.broadcast(each), F.lit(True)).where(~(F.col("regular") & F.col("asked_regular")))
        return near.unionByName(plain.select(key, id_, distance))

    if blocks <= 1:
        scored = met(asked)
    else:
        dealt = settle(asked.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks))), "queries")
        scored = reduce(DataFrame.unionByName, (met(dealt.where(F.col("block") == k).drop("block")) for k in range(blocks)))
    return top_per(scored, [key], [F.col("distance"), F.col(id_)], n)


def category_signal(queries: DataFrame, places: DataFrame, n: int = POOL) -> DataFrame:
    """query_id, place_id, rank: places of the query's category, in the order of their ids.

    The first n of each category are taken before they meet queries, so a query meets n places at most.
    """
    first = top_per(places.where("category is not null").select("category", "place_id"), ["category"], [F.col("place_id")], n)
    return queries.select("query_id", "category").join(first, "category").select("query_id", "place_id", "rank")


def nearby_signal(queries: DataFrame, places: DataFrame, n: int = POOL, *, radius_km: float = 20.0) -> DataFrame:
    """query_id, place_id, rank: places in the box around the query, by squared degrees.

    Circles grow to the box, doubling from one that holds some times n places where they lie densest: a query that finds n
    in a circle is done, since all that is nearer was seen. So queries meet few places where these are many.
    """
    asked = settle(queries.where("lat is not null and lon is not null").select("query_id", F.col("lat").alias("qlat"), F.col("lon").alias("qlon")), "nearby-queries")
    places = places.where("lat is not null and lon is not null").select("place_id", "lat", "lon")
    tall = radius_km / 111.0
    crowds = places.groupBy(geo.cell(F.col("lat"), F.col("lon"), tall).alias("cell")).count()
    crowd = crowds.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0.0
    dy, dx = geo.box(F.col("qlat"), F.col("qlon"), radius_km)
    d2 = F.pow(F.col("lat") - F.col("qlat"), 2) + F.pow(F.col("lon") - F.col("qlon"), 2)
    within = (F.abs(F.col("lat") - F.col("qlat")) <= dy) & (F.abs(F.col("lon") - F.col("qlon")) <= dx)
    out = []
    for i in range(max(0, math.ceil(math.log(max(1.0, 4 * crowd / (SPARE * n)), 4))), -1, -1):
        size = tall / 2**i
        span = lambda at, by: F.sequence(F.floor((at - by) / size - 1e-6).cast("int"), F.floor((at + by) / size + 1e-6).cast("int"))  # noqa: B023, E731
        rows, columns = span(F.col("qlat"), F.lit(size)), span(F.col("qlon"), F.lit(size) if i else dx)
        cells = F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.struct(y.alias("cy"), x.alias("cx")))))  # noqa: B023
        dealt = asked.withColumn("cell", F.explode(cells))
        own = F.broadcast(dealt) if dealt.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else dealt.hint("merge")
        met = places.withColumn("cell", geo.cell(F.col("lat"), F.col("lon"), size)).join(own, "cell").where(within).select("query_id", "place_id", d2.alias("d2"))
        first = top_per(met.where(F.col("d2") <= size * size) if i else met, ["query_id"], [F.col("d2"), F.col("place_id")], n)
        if not i:
            return reduce(DataFrame.unionByName, [*out, first])
        found = settle(first.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).where(F.col("_n") == n).drop("_n"), "nearby")
        out.append(found)
        asked = settle(asked.join(found.where(F.col("rank") == n).select("query_id"), "query_id", "left_anti"), "nearby-queries")
    raise AssertionError


def alias_signal(queries: DataFrame, aliases: DataFrame, n: int = POOL, *, least: float = 0.45) -> DataFrame:
    """query_id, place_id, score, rank: the best trigram similarity of a place's aliases; candidates share a trigram."""
    grams = lambda c: F.array_distinct(text.ordered_trigrams(c))
    asked = queries.select("query_id", "words", F.size(grams(F.col("words"))).alias("n_asked"), F.explode(grams(F.col("words"))).alias("gram"))
    names = aliases.select("alias").distinct().select("alias", F.size(grams(F.col("alias"))).alias("n_alias"), F.explode(grams(F.col("alias"))).alias("gram"))
    common = asked.join(names, "gram").groupBy("query_id", "alias", "n_asked", "n_alias").agg(F.count("*").alias("both"))
    scored = common.withColumn("score", F.col("both") / (F.col("n_asked") + F.col("n_alias") - F.col("both"))).where(F.col("score") >= least)
    best = scored.join(aliases.select("alias", "place_id").distinct(), "alias").groupBy("query_id", "place_id").agg(F.max("score").alias("score"))
    return top_per(best, ["query_id"], [F.desc("score"), F.col("place_id")], n)


def fuse(signals: list[DataFrame], n: int = RESULTS, *, key: str = "query_id", id_: str = "place_id") -> DataFrame:
    """key, id_, score, rank: sums of 1 / (60 + rank); ties go to the earlier signal, then the better rank in it, then the smaller id."""
    all_ = reduce(DataFrame.unionByName, (s.select(key, id_, "rank", F.lit(i).alias("signal")) for i, s in enumerate(signals)))
    score = F.sum(F.lit(1.0) / (F.col("rank") + RRF_K))
    fused = all_.groupBy(key, id_).agg(score.alias("score"), F.min(F.struct("signal", "rank")).alias("seen"))
    # Sums are rounded so that the order of adding doesn't decide between equal scores.
    return top_per(fused.withColumn("score", F.round("score", 9)), [key], [F.desc("score"), F.col("seen"), F.col(id_)], n).drop("seen")
