"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

The mix minimises the entropy of the documents' rates relative to taking each once, under one word constraint for
each source and a cap on every rate. The dual is convex with one multiplier per source, and its optimum is an
exponential tilt: a document is taken ``min(cap, exp(tilt * size / scale))`` times, so a source that has to give more
words than it holds gives them from its longer documents, and one that has to give fewer from its shorter ones. Newton
steps run over the numbers of documents per source and size, until every source meets its target.

Rates become whole copies per source and size: the running sum of expected copies is rounded from the largest size
down, then what a source still lacks or has too much is settled on the sizes that fit it best. The copies of a size go
to its documents by hash, in slices, so that no source and no size is handled as one group.

Defined results: null texts have size 0; the null source is a source of its own; documents of size 0 are taken once,
which adds no words; a source whose target is at least cap times its size is taken cap times, one with target 0 not at
all; repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Documents of one source and size are dealt out in so many slices.
SLICES = 256
#: The sizes and the documents of a source are joined to it in so many parts.
SOURCE_SALTS = 64
#: Newton steps of one job, and jobs at most: with halving, more than any tilt takes. What counts as met: a share of the target, or of a word.
NEWTON_STEPS = 4
NEWTON_JOBS = 20
TOLERANCE = 1e-6
MET_WORDS = 0.01
#: Sums in this type are the same in any order.
EXACT = "decimal(38,6)"
#: Fractions of a copy, and bands of sizes a doubling, while copies are rounded.
UNIT = 1 << 20
BANDS = 8
#: How far the difference of two sizes that change copies may be from the words that a source lacks.
NEAR = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null, for joins."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def ordered_rank(df: DataFrame, order: Column) -> DataFrame:
    """Adds rank, from 0, over all of df, without gathering it in one task."""
    placed = settle(df.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranks")
    sizes = placed.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return placed.withColumn("own", own).join(sizes.select("part", "before"), "part").withColumn("rank", F.col("own") + F.col("before") - 1).drop("part", "own", "before")


def capped_shares(sources: DataFrame, cap: float) -> DataFrame:
    """sources: key, size, weight. Adds target: shares of all sizes by weight, none above cap times the own size, the excess reshared by weight."""
    total, weights = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("double"), F.coalesce(F.sum("weight"), F.lit(0)).cast("double")).first()
    level = total / weights if weights else 0.0
    while True:  # rises, and ends when no further source reaches its cap
        full = F.col("size") * cap <= F.col("weight") * level
        taken, open_ = sources.agg(F.coalesce(F.sum(F.when(full, F.col("size") * F.lit(float(cap)))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight").cast("double"))), F.lit(0.0))).first()
        after = (total - taken) / open_ if open_ else level
        if after <= level:
            break
        level = after
    return sources.withColumn("target", F.least(F.col("size") * F.lit(float(cap)), F.col("weight") * F.lit(level)))


def _with_source(rows: DataFrame, sources: DataFrame, how: str = "inner", *, by: str = "size") -> DataFrame:
    """rows with their source's row; those of one source are dealt out over several tasks."""
    salt = F.pmod(F.xxhash64(by), F.lit(SOURCE_SALTS)).cast("int")
    each = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SOURCE_SALTS - 1))))
    return rows.withColumn("salt", salt).join(each, ["key", "salt"], how).drop("salt")


def tilts(sizes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """sizes: key, size, docs. targets: key, target in words. key, target, scale, tilt, live: Newton steps on the dual.

    The optimum takes a document ``min(cap, exp(tilt * size / scale))`` times, where scale is the source's mean size.
    Each step adds up words taken and their slope per source, with partial sums where the sizes lie; sums are exact
    decimals, so that reruns agree. A step that leaves the bracket, which every step narrows, is replaced by its
    middle. Sources with target 0, or at their cap, are not live.
    Targets that aren't met in the end are an error.
    """
    held = F.when(F.col("size") > 0, F.col("size"))
    own = sizes.groupBy("key").agg(F.sum(F.col("docs") * F.col("size")).cast("double").alias("words"), F.sum(F.when(F.col("size") > 0, F.col("docs"))).alias("n"), F.min(held).alias("least"))
    scale = F.coalesce(F.col("words") / F.col("n"), F.lit(1.0))
    live = F.coalesce((F.col("target") > 0) & (F.col("target") < cap * F.col("words")), F.lit(False))
    # All documents at most at the lower end's rate, all at the cap at the upper end.
    low = F.when(F.col("target") < F.col("words"), F.log(F.col("target") / F.col("words")) * F.col("scale") / F.col("least")).otherwise(0.0)
    high = F.when(F.col("target") < F.col("words"), 0.0).otherwise(math.log(cap) * F.col("scale") / F.col("least"))
    state = targets.select("key", "target").join(own, "key").withColumn("scale", scale).withColumn("live", live)
    state = settle(state.select("key", "target", "scale", "live", low.alias("low"), high.alias("high"), F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("miss")), "tilts")
    names, idle, state = state.columns, state.where("not live"), state.where("live")
    for _ in range(NEWTON_JOBS):
        for _ in range(NEWTON_STEPS):
            raw = F.exp(F.col("tilt") * F.col("size") / F.col("scale"))
            met = _with_source(sizes.where("size > 0"), state).withColumn("words", (F.col("docs") * F.col("size")).cast("double")).withColumn("raw", raw)
            slope = F.when(F.col("raw") < cap, F.col("words") * F.col("size") * F.col("raw") / F.col("scale"))
            step = met.groupBy(*(c for c in names if c != "miss")).agg(
                F.sum((F.col("words") * F.least(F.lit(cap), F.col("raw"))).cast(EXACT)).cast("double").alias("got"), F.sum(slope.cast(EXACT)).cast("double").alias("slope")
            )
            over = F.col("got") - F.col("target")
            step = step.withColumn("low", F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(over > 0, F.col("tilt")).otherwise(F.col("high")))
            after = F.col("tilt") - over / F.col("slope")
            inside = (F.col("slope") > 0) & after.between(F.col("low"), F.col("high"))
            moved = F.when(over == 0, F.col("tilt")).when(inside, after).otherwise((F.col("low") + F.col("high")) / 2)
            step = step.select(*(c for c in names if c not in ("tilt", "miss")), moved.alias("tilt"), (F.abs(over) / F.col("target")).alias("miss"))
            state = step.select(*names)
        state = settle(state, "tilts")
        if state.where(F.col("miss") >= TOLERANCE).isEmpty():
            break
    else:
        # Sums have six decimals, so a share of a word is met as well as can be; anything else would be a wrong mix.
        unmet = state.where((F.col("miss") >= TOLERANCE) & (F.col("miss") * F.col("target") >= MET_WORDS)).select("key", "target", "miss").limit(5).collect()
        if unmet:
            raise ArithmeticError(f"no tilt meets the targets of these sources, by that share: {unmet}")
    return state.unionByName(idle).select("key", "target", "scale", "tilt", "live")


def rate(size: Column, cap: float) -> Column:
    """How often the mix takes a document of this size, given its source's tilt."""
    tilted = F.least(F.lit(cap), F.exp(F.col("tilt") * size / F.col("scale")))
    return F.when(size == 0, 1.0).when(F.col("live"), tilted).when(F.col("target") > 0, cap).otherwise(0.0)


def _copies_per_size(sizes: DataFrame, cap: int) -> DataFrame:
    """sizes: key, size, docs, rate, target. Adds copies: how many the documents of that size get together.

    The running sum of expected copies, from the largest size down, is rounded; it is taken over bands of sizes first
    and then within each, so that no source is one group. Expected copies are whole multiples of 1 / UNIT.
    """
    most = F.col("docs") * cap
    banded = sizes.withColumn("due", F.round(F.col("docs") * F.col("rate") * UNIT).cast("long")).withColumn("band", F.floor(F.log2(F.col("size") + 1) * BANDS))
    bands = banded.groupBy("key", "band").agg(F.sum("due").alias("all"))
    bands = bands.withColumn("before", F.sum("all").over(Window.partitionBy("key").orderBy(F.desc("band"))) - F.col("all"))
    down = Window.partitionBy("key", "band").orderBy(F.desc("size"))
    whole = lambda x: F.floor((x + UNIT // 2) / UNIT)
    out = banded.join(bands.select("key", "band", "before"), ["key", "band"]).withColumn("run", F.col("before") + F.sum("due").over(down))
    out = out.select("key", "size", "docs", "target", F.least(most, F.greatest(F.lit(0), whole(F.col("run")) - whole(F.col("run") - F.col("due")))).cast("long").alias("copies"))
    for _ in range(2):  # what a source still lacks or has too much goes to the size that fits it best
        out = settle(out, "copies")
        step = F.greatest(-F.col("copies"), F.least(most - F.col("copies"), F.round(F.col("lack") / F.col("size")).cast("long")))
        fit = _with_source(out.where("size > 0"), _lack(out)).withColumn("step", step)
        best = fit.groupBy("key").agg(F.min(F.struct(F.abs(F.col("lack") - F.col("step") * F.col("size")), "size", "step")).alias("best"))
        chosen = F.coalesce(F.col("best.size") == F.col("size"), F.lit(False))
        out = _with_source(out, best, "left").withColumn("copies", F.col("copies") + F.when(chosen, F.col("best.step")).otherwise(0)).drop("best")
    # The rest by one copy more of a size and one fewer of another, whose difference is the lack, or near it.
    out = settle(out, "copies")
    near = F.transform(F.sequence(F.lit(-NEAR), F.lit(NEAR)), lambda d: F.round(F.col("lack")).cast("long") + d)
    more = _with_source(out.where(F.col("copies") < most), _lack(out).where(F.abs("lack") >= 1)).select("key", "lack", F.col("size").alias("more"), F.explode(near).alias("by"))
    fewer = out.where("copies > 0").select("key", F.col("size").alias("fewer"))
    swap = more.withColumn("fewer", F.col("more") - F.col("by")).where(F.abs(F.col("lack") - F.col("by")) < F.abs("lack")).join(fewer, ["key", "fewer"])
    swap = swap.groupBy("key").agg(F.min(F.struct(F.abs(F.col("lack") - F.col("by")), "more", "fewer")).alias("swap"))
    moved = F.when(F.col("swap.more") == F.col("size"), 1).when(F.col("swap.fewer") == F.col("size"), -1).otherwise(0)
    out = _with_source(out, swap, "left").withColumn("copies", F.col("copies") + moved)
    return out.select("key", "size", "docs", "copies")


def _lack(sizes: DataFrame) -> DataFrame:
    """key, lack: the words that copies leave each source short of its target."""
    return sizes.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("lack"))


def balance(docs: DataFrame, targets: DataFrame, *, cap: int = 3) -> DataFrame:
    """docs: id, key, size. targets: key, target in words. id, key, size, rate, copies for every row of docs whose key has a target."""
    docs = docs.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int"))
    slices = settle(docs.groupBy("key", "size", "slice").agg(F.count("*").alias("docs")), "sizes")
    sizes = settle(slices.groupBy("key", "size").agg(F.sum("docs").alias("docs")), "size-totals")
    rated = _with_source(sizes, tilts(sizes, targets, float(cap))).withColumn("rate", rate(F.col("size"), float(cap)))
    planned = _copies_per_size(rated, cap).join(rated.select("key", "size", "rate"), ["key", "size"])
    bins = slices.withColumnRenamed("docs", "own").join(planned, ["key", "size"])
    before = F.sum("own").over(Window.partitionBy("key", "size").orderBy("slice")) - F.col("own")
    each = F.floor(F.col("copies") / F.col("docs")).cast("long")
    quota = bins.select("key", "size", "slice", "rate", each.alias("each"), (F.col("copies") - each * F.col("docs") - before).alias("more"))
    ranked = docs.withColumn("place", F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy(F.xxhash64("id"), "id")))
    return ranked.join(quota, ["key", "size", "slice"]).select("id", "key", "size", "rate", (F.col("each") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0)).alias("copies"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Weights go to the sources in code-point order (null last), repeating. id_col, size, source_size, target, taken, copies, rate for every row."""
    each = settle(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("key"), word_count(F.col(text_col)).alias("size")), "sizes")
    sources = each.groupBy("key", "source").agg(F.sum("size").alias("size"))
    ranked = ordered_rank(sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    targets = settle(capped_shares(settle(ranked.select("key", "size", weight.alias("weight")), "weights"), cap).select("key", F.col("size").alias("source_size"), "target"), "targets")
    out = _with_source(balance(each.select("id", "key", "size"), targets, cap=cap), targets, by="id")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")
