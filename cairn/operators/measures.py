"""Measuring answers: matching, agreement of order, spread, resamples, pass rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .groups import Columns, by_group, dealt
from .staging import settle
from .tours import ordered

#: Fixed values of the resampling: how many, the seed, and what the interval leaves out.
RESAMPLES = 10_000
SEED = 20260926
ALPHA = 0.05


def greedy_matches(reference: DataFrame, answer: DataFrame, *, key: str, metres: float = 750.0) -> DataFrame:
    """key, ordinal, matched, metres: reference stops, in order, take the nearest answer stop not yet taken.

    The order decides, so a case is matched in one task; a case holds the stops of two walks. Cases of as many stops are
    matched at once, stop by stop.
    """

    def solve(own: Columns) -> Columns:
        asked = own["answered"] == 0  # of each case the first ones
        n_asked, (many, n) = asked.sum(axis=1), asked.shape
        matched, far = np.full((many, n), np.nan), np.full((many, n), np.nan)
        step = max(1, CELLS // (n * n))
        for k in range(0, many, step):
            at, sizes = np.arange(k, min(many, k + step)), n_asked[k : k + step]
            low, most = int(sizes.min()), int(sizes.max())
            lat, lon = own["lat"][at], own["lon"][at]
            p, q = np.radians(lat)[:, :most, None], np.radians(lat)[:, None, low:]
            h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon[:, None, low:] - lon[:, :most, None]) / 2) ** 2
            d = 2 * geo.EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))
            d[~(d <= metres) | (np.arange(low, n) < sizes[:, None])[:, None, :]] = np.inf
            for i in range(most if d.size else 0):
                j = d[:, i].argmin(axis=1)  # of equals the first
                best = d[at - k, i, j]
                hit = np.flatnonzero(np.isfinite(best) & (i < sizes))
                matched[at[hit], i], far[at[hit], i] = own["ordinal"][at[hit], low + j[hit]], best[hit]
                d[hit, :, j[hit]] = np.inf
        return {key: own[key][asked], "ordinal": own["ordinal"][asked], "matched": matched[asked], "metres": far[asked]}

    cols = [key, "ordinal", "lat", "lon"]
    both = reference.select(*cols, F.lit(0).alias("answered")).unionByName(answer.select(*cols, F.lit(1).alias("answered")))
    out = by_group(both, key, ["answered", "ordinal"], solve, f"{key} long, ordinal int, matched double, metres double", stacked=True)
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return out.select(key, "ordinal", known("matched").cast("int").alias("matched"), known("metres").alias("metres"))


def match_scores(reference: DataFrame, answer: DataFrame, plans: DataFrame, *, key: str, metres: float = 750.0) -> DataFrame:
    """key, recall, precision, detour_km, walk_diff_min, budget_fit of each reference walk.

    The detour is the answer's line, in the order of its stops, less the shortest walk through the reference's; null
    without an answer.
    plans: key, walk_seconds and fits of the answer, walk_minutes of it, and est_walk_minutes of the reference;
    without an estimate the walk is held against its own minutes.
    """
    length = lambda rows, name: _line_km(rows, key).select(key, F.col("km").alias(name))
    places = reference.withColumn("place_id", F.col("ordinal").cast("long"))
    shortest = ordered(places, method="shortest_reference", key=key).where("position = 0").select(key, (F.col("seconds") * F.lit(geo.SPEEDS["foot"] / 3600)).alias("ref_km"))
    by = greedy_matches(reference, answer, key=key, metres=metres).groupBy(key).agg(F.count("matched").alias("met"), F.count("*").alias("asked"))
    out = by.join(answer.groupBy(key).agg(F.count("*").alias("given")), key, "left").join(shortest, key, "left").join(length(answer, "own_km"), key, "left").join(plans, key, "left")
    seconds = F.coalesce("walk_seconds", F.col("walk_minutes") * 60, F.lit(0.0))
    return out.select(
        key,
        (F.col("met") / F.col("asked")).alias("recall"),
        F.when(F.col("given") > 0, F.col("met") / F.col("given")).otherwise(0.0).alias("precision"),
        (F.col("own_km") - F.col("ref_km")).alias("detour_km"),
        (seconds / 60 - F.coalesce("est_walk_minutes", "walk_minutes")).alias("walk_diff_min"),
        F.coalesce("fits", F.lit(False)).alias("budget_fit"),
    )


def _line_km(stops: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("ordinal")
    leg = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return stops.select(key, leg.alias("m")).groupBy(key).agg((F.coalesce(F.sum("m"), F.lit(0.0)) / 1000).alias("km"))


def kendall_tau(ranks: DataFrame, key: str) -> DataFrame:
    """key, n, tau over shared elements; null for fewer than three. ranks: key, a, b (places in two orders)."""
    x = ranks.select(key, F.col("a").alias("a1"), F.col("b").alias("b1"))
    y = ranks.select(key, F.col("a").alias("a2"), F.col("b").alias("b2"))
    pairs = x.join(y, key).where("a1 < a2").groupBy(key).agg(F.sum(F.signum((F.col("a2") - F.col("a1")) * (F.col("b2") - F.col("b1")))).alias("s"), F.count("*").alias("pairs"))
    sizes = ranks.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.join(pairs, key, "left").select(key, "n", F.when(F.col("n") >= 3, F.col("s") / F.col("pairs")).alias("tau"))


def nearest_rank(values: Column, q: float) -> Column:
    """Of an array: the element at min(n - 1, int(q * n)), counted from 0."""
    own = F.array_sort(values)
    n = F.size(own)
    return F.when(n > 0, F.element_at(own, (F.least(n - 1, F.greatest(F.lit(0), F.floor(n * F.lit(q)).cast("int"))) + 1).cast("int")))


def spread(runs: DataFrame, key: str, metric: str) -> DataFrame:
    """key, n, mean, half_range, sd: nulls skipped, failed runs left out."""
    own = runs.where("failure is null")
    m = F.col(metric)
    return own.groupBy(key).agg(F.count(m).alias("n"), F.avg(m).alias("mean"), ((F.max(m) - F.min(m)) / 2).alias("half_range"), F.stddev_samp(m).alias("sd"))


#: Different values of a block, and cells of a table (of draws, of distances) that a task holds.
BLOCK = 1024
CELLS = 1 << 20


def _generator(seed: int, key: int, level: int, node: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, key % (1 << 64), level + 1, node])))


def _block_totals(block: dict, resamples: int, seed: int) -> np.ndarray:
    """Of each resample the sum of what falls to a block: binomial draws on the way down to it, then a multinomial one."""
    draws = np.full(resamples, block["n"], np.int64)
    for step in block["way"]:
        left = _generator(seed, block["hash"], step["level"], step["parent"]).binomial(draws, step["left"] / step["both"])
        draws = draws - left if step["node"] % 2 else left
    held = sorted((x["v"], x["times"]) for x in block["held"])
    v, times = np.array([x for x, _ in held]), np.array([n for _, n in held], float)
    own, each = _generator(seed, block["hash"], -1, block["leaf"]), max(1, CELLS // len(v))
    return np.concatenate([own.multinomial(draws[k : k + each], times / times.sum()) @ v for k in range(0, resamples, each)])


def _resampled(values: DataFrame, key: str, value: str, resamples: int, seed: int, block: int = BLOCK) -> DataFrame:
    """key, resample, m: the mean of each resample. values: key, value (double, not null).

    A resample draws as many rows as there are. Equal values are drawn together: counts of different values are
    multinomial, weighted by their numbers of rows. A key's different values lie in blocks, blocks are the leaves of a
    binary tree, and the draws of every resample are dealt out from its root by binomial splits. A node's generator
    depends on the seed, the key and the node alone, so tasks agree on the part of the way that their blocks share
    without meeting.
    """
    own = values.select(F.struct(F.col(key)).alias("k"), F.col(value).alias("v"))  # a struct: null is a key as any other
    counted = settle(own.groupBy("k", "v").agg(F.count(F.lit(1)).alias("times")), "values")
    sizes = counted.groupBy("k").agg(F.ceil(F.log2(F.count(F.lit(1)) / F.lit(float(block)))).alias("levels"), F.sum("times").alias("n"))
    sizes = sizes.select("k", F.greatest(F.lit(0), F.col("levels")).cast("int").alias("levels"), "n")
    leaf = F.pmod(F.xxhash64("v"), F.pow(F.lit(2.0), "levels").cast("long")).alias("leaf")
    blocks = counted.join(sizes, "k").select("*", leaf).groupBy("k", "leaf", "levels", "n").agg(F.collect_list(F.struct("v", "times")).alias("held"), F.sum("times").alias("w"))
    blocks = settle(blocks, "blocks")
    # Nodes: a leaf's leading bits, as many as its level.
    ways = blocks.select("k", "leaf", "w", F.explode(F.expr("transform(sequence(0, levels), d -> struct(d AS level, shiftright(leaf, levels - d) AS node))")).alias("at")).select("k", "leaf", "w", "at.*")
    weights = ways.groupBy("k", "level", "node").agg(F.sum("w").alias("weight"))
    steps = ways.where("level > 0").select("k", "leaf", "level", "node", F.shiftright("node", 1).alias("parent"))
    above = weights.select("k", (F.col("level") + 1).alias("level"), F.col("node").alias("parent"), F.col("weight").alias("both"))
    left = weights.where("node % 2 = 0").select("k", "level", F.shiftright("node", 1).alias("parent"), F.col("weight").alias("left"))
    steps = steps.join(above, ["k", "level", "parent"]).join(left, ["k", "level", "parent"], "left")
    way = steps.groupBy("k", "leaf").agg(F.array_sort(F.collect_list(F.struct("level", "node", "parent", F.coalesce("left", F.lit(0)).alias("left"), "both"))).alias("way"))
    whole = blocks.select("k", "leaf", "n", "held", F.xxhash64("k").alias("hash")).join(way, ["k", "leaf"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                totals = _block_totals(row | {"way": row["way"] or []}, resamples, seed)
                own = batch.column("k").take(pa.array(np.full(resamples, k)))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.arange(resamples, dtype=np.int32)), pa.array(totals), pa.array(np.full(resamples, row["n"]))], names=["k", "resample", "total", "n"])

    kind = values.schema[key].dataType.simpleString()
    sums = dealt(whole, "k", "leaf").mapInArrow(run, f"k struct<{key}: {kind}>, resample int, total double, n long")
    return sums.groupBy("k", "resample").agg((F.sum("total") / F.first("n")).alias("m")).select(F.col(f"k.{key}").alias(key), "resample", "m")


def bootstrap(values: DataFrame, key: str, value: str, *, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """key, mean, low, high: percentile interval (nearest rank) of the mean over resamples of as many rows. Null values are left out."""
    own = values.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    means = _resampled(own, key, "v", resamples, seed).groupBy(key).agg(F.collect_list("m").alias("ms"))  # resamples of them
    means = means.select(F.col(key).alias("_k"), nearest_rank(F.col("ms"), alpha / 2).alias("low"), nearest_rank(F.col("ms"), 1 - alpha / 2).alias("high"))
    return own.groupBy(key).agg(F.avg("v").alias("mean")).join(means, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def paired(a: DataFrame, b: DataFrame, case: str, value: str, *, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """One row: difference of b to a over shared cases, its interval (nearest rank), and a two-sided p of at least 1 / resamples.

    One case has a difference and no interval; none, no difference either.
    """
    both = a.select(case, F.col(value).alias("x")).join(b.select(case, F.col(value).alias("y")), case).where("x is not null and y is not null")
    d = both.select(F.lit(0).alias("all"), (F.col("y") - F.col("x")).cast("double").alias("d"))
    means = _resampled(d, "all", "d", resamples, seed)
    tails = means.agg(F.collect_list("m").alias("ms"), F.count_if(F.col("m") <= 0).alias("down"), F.count_if(F.col("m") >= 0).alias("up"))
    p = F.greatest(F.lit(1.0 / resamples), F.least(F.lit(1.0), F.least("down", "up") * 2 / resamples))
    tails = tails.select(nearest_rank(F.col("ms"), alpha / 2).alias("low"), nearest_rank(F.col("ms"), 1 - alpha / 2).alias("high"), p.alias("p"))
    many = lambda c: F.when(F.col("cases") > 1, F.col(c)).alias(c)
    return d.agg(F.avg("d").alias("difference"), F.count("*").alias("cases")).join(tails, F.lit(True)).select("difference", "cases", many("low"), many("high"), many("p"))


def first_failure(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that fails; null if all pass. Null fails."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in checks))


def merged_repeats(results: DataFrame, key: str) -> DataFrame:
    """key, passed (only if all repeats pass), reason (of the first repeat that fails)."""
    bad = F.col("reason").isNotNull()
    return results.groupBy(key).agg((~F.bool_or(bad)).alias("passed"), F.min_by("reason", F.when(bad, F.col("repeat"))).alias("reason"))


def run_lengths(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Adds run: how many rows in a row have had the flag, up to and with each; 0 without it."""
    w = Window.partitionBy(key).orderBy(*order)
    block = F.sum(F.when(flag, 0).otherwise(1)).over(w)
    marked = rows.withColumn("_block", block).withColumn("_flag", flag)
    inner = Window.partitionBy(key, "_block").orderBy(*order)
    return marked.withColumn("run", F.sum(F.when(F.col("_flag"), 1).otherwise(0)).over(inner)).drop("_block", "_flag")
