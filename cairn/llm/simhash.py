"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits of each other share a variant that is within half the radius of both. So
every distinct fingerprint stands for all its variants within ``radius // 2`` flipped bits, and equal variants
meet. Variants are dealt out by their top ``t`` bits: a fingerprint is sent once to each prefix that its variants
can have (1 + t + t(t-1)/2 rows of 16 bytes for half radius 2, not 2 081), and the owner of a prefix writes out the
variants that fall under it, so each variant is made exactly once and in one place. ``t`` follows the number of
fingerprints, and prefixes that hold many (large groups of near copies) are lengthened until they don't.

Fingerprints that meet at a variant are within the radius by the triangle inequality, which is checked on every
link. Only a star is linked per variant and only a forest per task, so a group of n copies costs O(n) links.
Components come from alternating large-star and small-star rounds, each written to the shared folder.

Defined results: null, empty and word-free texts have fingerprint zero and are linked like any other; a text of
fewer words than a shingle has one shingle; repeated rows each get a row; a null id is kept and never names a
component unless all its ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, salted_join, settle

BITS = 64
#: Variants that one task sorts at once; and heavy prefixes, of 8 bytes each, that may be broadcast.
TASK_VARIANTS = 3_000_000
HEAVY_KEYS = 1_000_000


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= words_per_shingle:
        shingles = [joined]
    else:
        shingles = [joined[a : b - 1] for a, b in zip([0, *ends], islice(ends, words_per_shingle - 1, None))]  # noqa: B905  the first is longer
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), np.uint8)
    ones = np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            fps = np.array([fingerprint(t, words_per_shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _masks(positions: range, flips: int) -> np.ndarray:
    """All masks with exactly so many of the bits at positions set."""
    return np.array([sum(1 << b for b in c) for c in combinations(positions, flips)], np.uint64)


def _choose(n: int, most: int) -> int:
    """In how many ways at most so many of n bits can flip."""
    return sum(math.comb(n, k) for k in range(most + 1))


def _variants(fps: np.ndarray, prefix: int, t: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The variants of fps within half flips whose top t bits are prefix, and the index of their fingerprint."""
    low = BITS - t
    top = (fps >> np.uint64(low)) if t else np.zeros(len(fps), np.uint64)
    moved = np.bitwise_count(top ^ np.uint64(prefix)).astype(int)
    under = np.uint64((1 << low) - 1)
    based = (fps & under) | np.uint64(prefix << low if t else 0)
    out, owners = [], []
    for flips in range(half + 1):
        masks = np.concatenate([_masks(range(low), k) for k in range(half - flips + 1)])
        own = np.flatnonzero(moved == flips)
        out.append((based[own, None] ^ masks).ravel())
        owners.append(np.repeat(own, len(masks)))
    return np.concatenate(out), np.concatenate(owners)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n nodes and links a-b, the smallest node that each is joined to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _links(fps: np.ndarray, prefix: int, t: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that meet at a variant under this prefix, as a forest (from, to the smaller)."""
    v, who = _variants(fps, prefix, t, radius // 2)
    order = np.argsort(v)
    v, who = v[order], who[order]
    same = np.flatnonzero(v[1:] == v[:-1]) + 1
    if not len(same):
        return fps[:0], fps[:0]
    head = np.where(np.r_[True, v[1:] != v[:-1]], np.arange(len(v)), 0)
    head = np.maximum.accumulate(head)[same]
    a, b = who[head], who[same]
    near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    root = _forest(len(fps), a[near], b[near])
    joined = np.flatnonzero(root != np.arange(len(fps)))
    return fps[joined], fps[root[joined]]


def _flips(own: Column, n: int, most: int) -> Column:
    """Of the n bits own, all changes of at most so many: structs of the bits then, and how many flipped."""
    masks = [(int(m), k) for k in range(most + 1) for m in _masks(range(n), k)]
    return F.transform(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for m, k in masks)), lambda x: F.struct(own.bitwiseXOR(x["m"].cast("long")).alias("bits"), x["k"].alias("flips")))


def links(fps: DataFrame, *, radius: int = 4) -> DataFrame:
    """fps: fp long, each once. Links u, v (u > v as longs) that join all fingerprints within the radius, which is even."""
    if radius % 2:
        raise ValueError("fingerprints that meet within half an odd radius may be further apart than the radius")
    half = radius // 2
    per = _choose(BITS, half)
    n = fps.count()
    # Variants of a task: n * C(64, half) / 2**t, about.
    t = min(24, max(0, int(np.ceil(np.log2(max(1, n * per / TASK_VARIANTS))))))
    prefix = F.shiftrightunsigned("fp", BITS - t).cast("long") if t else F.lit(0).cast("long")
    sent = fps.select("fp", F.explode(_flips(prefix, t, half)).alias("to")).select("fp", F.col("to.bits").alias("prefix"), F.col("to.flips").alias("flips"))
    # Only prefixes near one that holds many fingerprints can have many more variants than the mean.
    crowded = fps.groupBy(prefix.alias("own")).count().where(F.col("count") * per > TASK_VARIANTS)
    near = crowded.select("count", F.explode(_flips(F.col("own"), t, half)).alias("to"))
    heavy = _heavy(near.select(F.col("to.bits").alias("prefix"), F.col("to.flips").alias("flips"), "count"), t, half)
    dealt = []
    while t < BITS and not heavy.isEmpty():
        small = F.broadcast(heavy) if heavy.count() <= HEAVY_KEYS else heavy
        dealt.append(sent.join(small, "prefix", "left_anti").select("fp", "prefix", F.lit(t).alias("t")))
        # The next bits join the prefix: a fingerprint goes on to those that its flips still reach.
        more = min(8, BITS - t)
        following = F.shiftrightunsigned("fp", BITS - t - more).bitwiseAND(F.lit((1 << more) - 1).cast("long"))
        sent = sent.join(small, "prefix", "left_semi").select("fp", "prefix", "flips", F.explode(_flips(following, more, half)).alias("to")).where(F.col("flips") + F.col("to.flips") <= half)
        sent = settle(sent.select("fp", F.shiftleft("prefix", more).bitwiseOR(F.col("to.bits")).alias("prefix"), (F.col("flips") + F.col("to.flips")).alias("flips")), "prefixes")
        t += more
        heavy = _heavy(sent.groupBy("prefix", "flips").count(), t, half)
    dealt.append(sent.select("fp", "prefix", F.lit(t).alias("t")))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(rows["fp"].to_numpy(np.int64)).view(np.uint64)
        t = int(rows["t"].iloc[0])
        u, v = _links(own, int(rows["prefix"].iloc[0]) % (1 << t), t, radius)
        u, v = u.view(np.int64), v.view(np.int64)
        return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return reduce(DataFrame.unionByName, dealt).groupBy("t", "prefix").applyInPandas(meet, "u long, v long").distinct()


def _heavy(sent: DataFrame, t: int, half: int) -> DataFrame:
    """sent: prefix, flips, count. Prefixes of t bits under which more variants fall than one task should sort."""
    each = F.element_at(F.array(*(F.lit(_choose(BITS - t, half - k)) for k in range(half + 1))), F.col("flips") + 1)
    return settle(sent.groupBy("prefix").agg(F.sum(F.col("count") * each).alias("n")).where(F.col("n") > 2 * TASK_VARIANTS).select("prefix"), "heavy-prefixes")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v longs. node, root: each node but the roots with the smallest node of its component."""
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both.where("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, ["u"]).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = settle(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (smallest id that links lead to) for every row."""
    each = settle(fingerprints(docs, id_col=id_col, text_col=text_col, words_per_shingle=words_per_shingle), "fingerprints")
    groups = settle(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-groups")
    roots = settle(components(links(groups.select("fp"), radius=radius)), "roots")
    # Most fingerprints are linked to none, and need no name but their own; a root is linked to itself here.
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = settle(linked.join(groups, F.col("node") == F.col("fp")).select("fp", "root", "least"), "linked")
    named = salted_join(linked.select("fp", "root"), linked.groupBy("root").agg(F.min("least").alias("component_id")), ["root"])
    by_fp = groups.join(named.select("fp", "component_id", F.lit(True).alias("root_known")), "fp", "left").select("fp", F.when(F.col("root_known"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return salted_join(each, settle(by_fp, "names"), ["fp"]).select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
