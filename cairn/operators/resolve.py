"""Entity resolution: shadowed rows, twins, duplicates, declared merges, names in cascade."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from .groups import Columns, by_group
from .spatial import cell_size, nearest_k, radius_join
from .staging import settle, small_side


#: Owners whose rows no rule drops.
PROTECTED = ("curated", "dataset", "manual")
#: Owners whose rows are written by hand, which are taken first where several answer to a name.
BY_HAND = ("dataset", "manual")
#: Fields that tell which of two rows of one object says more.
TELLING = ("blurb", "fun_fact", "fun_facts", "opening_hours", "ticket", "ticket_price", "visit_minutes", "links")
#: Words that a curated name may hold beyond the place's own.
FILLERS = ("бывший", "в гродно")


def _is_protected() -> Column:
    return F.coalesce(F.col("owner").isin(*PROTECTED), F.lit(False))


def _by_hand() -> Column:
    return F.coalesce(F.col("owner").isin(*BY_HAND), F.lit(False))


def shadowed(rows: DataFrame, aliases: DataFrame, *, metres: float = 150.0) -> DataFrame:
    """place_id (automatic), keeper, metres: the nearest protected row that answers to its name, strictly nearer than metres.

    A protected row answers to its own name and to its aliases, any other to its own name alone. Rows without a name or
    place meet none; of equally near keepers the first by place_id. rows: place_id, name, lat, lon, owner; aliases:
    place_id, alias. Rows that share a name meet in their grid cells, nearest first, so a name that many places bear is no
    single group.
    """
    named = rows.where("lat is not null and lon is not null").select("place_id", "lat", "lon", _is_protected().alias("kept"), text.answered_name(F.col("name")).alias("name"))
    known = aliases.select("place_id", text.answered_name(F.col("alias")).alias("name"))
    auto = named.where("not kept and name <> ''").select("place_id", "name", "lat", "lon")
    at = named.where("kept")
    answers = at.select("place_id", "name", "lat", "lon").unionByName(at.drop("name").join(known, "place_id").select("place_id", "name", "lat", "lon")).where("name <> ''").distinct()
    kept = answers.select(F.col("place_id").alias("keeper"), "name", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = nearest_k(auto, kept, 1, metres, key=["place_id"], order=[F.col("keeper")], strict=True, on=("name",))
    return near.select("place_id", "keeper", "metres")


def richness(columns: list[str]) -> Column:
    """How many of the telling fields among columns are filled: not null, not empty, not zero."""
    filled = lambda c: ~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "[]")
    return sum((F.when(filled(c), 1).otherwise(0) for c in TELLING if c in columns), F.lit(0))


def twins(rows: DataFrame, *, metres: float = 5.0) -> DataFrame:
    """place_id, keeper: automatic rows that map one object, and the fullest of them, which stays.

    Rows of one normalised name and category form groups around their first row (the head, by place_id), with all that
    lie nearer to it than metres and belong to no earlier head. Groups aren't transitive, so their order matters. The
    row with most telling fields is the keeper, the first of equals. Rows of other owners, or without name or place,
    take no part.

    Rows in one spot share their head, so a spot goes through the walk once, however many rows lie in it; spots are
    split into clusters that no chain of near ones can cross (a cell with its empty surroundings), and a walk holds a
    cluster's heads, which lie metres apart.
    """
    size = cell_size(metres)
    named = rows.where("owner = 'auto' and lat is not null and lon is not null")
    named = named.select("place_id", text.answered_name(F.col("name")).alias("name"), F.coalesce("category", F.lit("")).alias("category"), "lat", "lon", richness(rows.columns).alias("rich")).where("name <> ''")
    spot = ["name", "category", "lat", "lon"]
    best = F.min(F.struct(-F.col("rich"), "place_id"))
    spots = settle(named.groupBy(*spot).agg(F.min("place_id").alias("first"), best.alias("best"), F.count(F.lit(1)).alias("n")), "spots")
    keyed = spots.withColumn("cell", geo.cell(F.col("lat"), F.col("lon"), size))
    # Cells of one name and category that touch belong together; the smallest cell of a patch names it.
    cells = keyed.select("name", "category", "cell").distinct()
    around = cells.select("name", "category", F.col("cell").alias("own"), F.explode(geo.cells_around(F.col("cell.cy") * F.lit(size) + size / 2, F.col("cell.cx") * F.lit(size) + size / 2, size)).alias("cell"))
    touching = settle(around.join(cells, ["name", "category", "cell"]), "touching")
    key = ["name", "category", "cell"]
    patch = settle(touching.groupBy("name", "category", F.col("own").alias("cell")).agg(F.min("cell").alias("patch")), "patches")
    while True:
        low = touching.join(patch, key).groupBy("name", "category", F.col("own").alias("cell")).agg(F.min("patch").alias("low"))
        # The patch's own cell may know a lower one already, so that chains are halved each round.
        far = patch.select("name", "category", F.col("cell").alias("low"), F.col("patch").alias("further"))
        next_ = low.join(far, ["name", "category", "low"]).join(patch.withColumnRenamed("patch", "before"), key)
        next_ = settle(next_.select(*key, F.least("low", "further").alias("patch"), (F.least("low", "further") < F.col("before")).alias("moved")), "patches")
        patch = next_.drop("moved")
        if next_.where("moved").isEmpty():
            break

    def walk(own: Columns) -> Columns:
        heads: list[tuple[float, float, int]] = []
        found = []
        for i, lat, lon in zip(own["first"].tolist(), own["lat"].tolist(), own["lon"].tolist(), strict=True):
            head = next((h[2] for h in heads if _metres(lat, lon, h[0], h[1]) < metres), None)
            if head is None:
                heads.append((lat, lon, i))
            found.append(i if head is None else head)
        return {"first": own["first"], "head": np.array(found)}

    placed = keyed.join(patch, key).withColumn("group", F.to_json(F.struct("name", "category", "patch")))
    heads = by_group(placed.select("group", "first", "lat", "lon"), "group", ["first"], walk, "first long, head long")
    headed = settle(spots.join(heads, "first"), "headed")
    kept = headed.groupBy("head").agg(F.min("best").alias("best"), F.sum("n").alias("rows")).where("rows > 1").select("head", F.col("best.place_id").alias("keeper"))
    return named.join(headed.join(kept, "head").select(*spot, "keeper"), spot).where("place_id <> keeper").select("place_id", "keeper")


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p = math.radians
    a = math.sin(p(lat2 - lat1) / 2) ** 2 + math.cos(p(lat1)) * math.cos(p(lat2)) * math.sin(p(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1.0, math.sqrt(a)))


def suspected_duplicates(rows: DataFrame, *, labels: list[str] | None = None, metres: float = 500.0, close: float = 30.0) -> DataFrame:
    """a, b, metres, close: rows of one normalised name and category nearer than metres, each pair once.

    Rows whose name is a generated label, or that lack name or place, take no part.
    """
    own = rows.where("lat is not null and lon is not null")
    if labels:
        own = own.where(~F.coalesce(text.generated_label(F.col("name"), labels), F.lit(False)))
    own = own.select("place_id", text.answered_name(F.col("name")).alias("name"), F.coalesce("category", F.lit("")).alias("category"), "lat", "lon").where("name <> ''")
    a = own.select(F.col("place_id").alias("a"), "name", "category", "lat", "lon")
    b = own.select(F.col("place_id").alias("b"), "name", "category", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = radius_join(a, b, metres, strict=True, on=("name", "category"))
    return near.where("a < b").select("a", "b", "metres", (F.col("metres") <= close).alias("close"))


def declared_merges(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """keep, drop, verdict: stale if either is gone, refused if the loser is protected, else merged.

    pairs: keep, drop (source_url). rows: place_id, source_url, owner; of several rows of an address the last counts.
    """
    last = rows.groupBy("source_url").agg(F.max_by("owner", "place_id").alias("owner"))
    keep = last.select(F.col("source_url").alias("keep"), F.lit(True).alias("has_keep"))
    drop = last.select(F.col("source_url").alias("drop"), F.lit(True).alias("has_drop"), _is_protected().alias("refused"))
    both = pairs.join(keep, "keep", "left").join(drop, "drop", "left")
    verdict = F.when(F.col("has_keep").isNull() | F.col("has_drop").isNull(), "stale").when(F.col("refused"), "refused").otherwise("merged")
    return both.select("keep", "drop", verdict.alias("verdict"))


def _grams(c: Column, n: int) -> Column:
    """All runs of n characters, once each."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


GRAM = 3


def containing(needles: DataFrame, names: DataFrame) -> DataFrame:
    """needle, known: names that hold a needle somewhere within.

    A needle is looked up by its rarest run of three characters (all of it, if it is shorter), and what that run fetches
    is verified. Names are indexed by the runs that needles ask for. needles: needle, not empty; names: known, each once.
    """
    runs = lambda c: F.explode(F.concat(_grams(c, GRAM), F.when(F.length(c) < GRAM, F.array(c)).otherwise(F.array().cast("array<string>"))))
    asked = settle(needles.select("needle", runs(F.col("needle")).alias("gram")).distinct(), "runs")
    wanted = asked.select("gram").distinct()
    sizes = sorted(r[0] for r in wanted.select(F.length("gram")).distinct().collect())  # GRAM at most
    if not sizes:
        return names.select(F.lit("").alias("needle"), "known").limit(0)
    every = F.explode(F.concat(*(_grams(F.col("known"), n) for n in sizes)))
    index = names.select("known", every.alias("gram")).join(small_side(wanted), "gram", "left_semi")
    often = index.groupBy("gram").count()
    rarest = asked.join(often, "gram").groupBy("needle").agg(F.min(F.struct("count", "gram")).alias("m")).select("needle", F.col("m.gram").alias("gram"))
    # A run that no name holds: the needle is nowhere.
    held = asked.groupBy("needle").agg(F.count("*").alias("runs")).join(asked.join(often, "gram").groupBy("needle").agg(F.count("*").alias("runs")), ["needle", "runs"], "left_semi")
    return index.join(small_side(rarest.join(held, "needle", "left_semi")), "gram").where(F.contains("known", F.col("needle"))).select("needle", "known")


def _far_apart(points: DataFrame, metres: float, key: str = "wanted_id") -> DataFrame:
    """key of those whose points lie more than metres apart somewhere. points: key, lat, lon.

    The box of the points decides most; where it doesn't, its corners of the hull do, taken part by part and then
    together, so that no task holds all points of a name.
    """
    box = points.groupBy(key).agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))))
    tall = geo.haversine_m(F.col("min_lat"), F.col("min_lon"), F.col("max_lat"), F.col("min_lon"))
    broad = F.least(*(geo.haversine_m(F.col(c), F.col("min_lon"), F.col(c), F.col("max_lon")) for c in ("min_lat", "max_lat")))
    across = tall + F.greatest(*(geo.haversine_m(F.col(c), F.col("min_lon"), F.col(c), F.col("max_lon")) for c in ("min_lat", "max_lat")))
    judged = box.select(key, (F.greatest(tall, broad) > metres).alias("wide"), (across <= metres).alias("narrow"))
    open_ = points.join(small_side(judged.where("not wide and not narrow").select(key)), key, "left_semi").distinct()

    def corners(own: pd.DataFrame) -> pd.DataFrame:
        return own.iloc[_hull(own["lat"].to_numpy(), own["lon"].to_numpy())]

    def widest(own: pd.DataFrame) -> pd.DataFrame:
        at = corners(own)
        lat, lon = at["lat"].tolist(), at["lon"].tolist()
        most = max(_metres(a, b, c, d) for a, b in zip(lat, lon, strict=True) for c, d in zip(lat, lon, strict=True))
        return own.iloc[:1][[key]].assign(wide=most > metres)

    kind = points.schema[key].dataType.simpleString()
    salted = open_.withColumn("salt", F.pmod(F.xxhash64("lat", "lon"), F.lit(64)))
    parts = salted.groupBy(key, "salt").applyInPandas(corners, f"{key} {kind}, lat double, lon double, salt long")
    wide = parts.drop("salt").groupBy(key).applyInPandas(widest, f"{key} {kind}, wide boolean")
    return judged.where("wide").select(key).unionByName(wide.where("wide").select(key))


def _hull(lat: np.ndarray, lon: np.ndarray) -> list[int]:
    """Which points are corners of the convex hull."""
    order = np.lexsort((lon, lat)).tolist()
    if len(order) < 4:
        return order
    found: set[int] = set()
    for way in (order, order[::-1]):
        chain: list[int] = []
        for i in way:
            while len(chain) > 1 and (lat[chain[-1]] - lat[chain[-2]]) * (lon[i] - lon[chain[-2]]) <= (lon[chain[-1]] - lon[chain[-2]]) * (lat[i] - lat[chain[-2]]):
                chain.pop()
            chain.append(i)
        found.update(chain)
    return sorted(found)


def named_in_cascade(wanted: DataFrame, rows: DataFrame, *, spread_m: float = 2000.0, fillers: tuple[str, ...] = FILLERS) -> DataFrame:
    """wanted_id, place_id, how: the row that a curated name means, and by which step.

    * ``exact``: rows of that name (case and outer blanks aside); one written by hand decides, else the first if they all
      lie within spread_m of each other, else the name is ``ambiguous``;
    * ``contains``: the only row whose name holds the wanted one, also within a word;
    * ``fuzzy``: the first row whose name holds the wanted one without fillers;
    * ``none``.

    The first is by hand before others, then by place_id. Both ``ambiguous`` and ``none`` have no place. A null name is
    empty, which every name holds. wanted: wanted_id, wanted; rows: place_id, name, lat, lon, owner. Names are compared
    once each, not once a row, and names that are asked for again share what was found.
    """
    short = F.col("asked")
    for filler in fillers:
        short = F.replace(short, F.lit(filler), F.lit(""))
    asked = settle(wanted.select("wanted_id", F.lower(F.coalesce("wanted", F.lit(""))).alias("asked")).withColumn("short", text.stripped(short)), "asked")
    known = rows.select("place_id", F.lower(F.coalesce("name", F.lit(""))).alias("known"), "lat", "lon", _by_hand().alias("hand"))
    first = F.min(F.struct(~F.col("hand"), "place_id"))
    texts = asked.select("asked").distinct()
    same = known.withColumn("asked", text.stripped(F.col("known"))).join(small_side(texts), "asked")
    same = settle(same.select("asked", "place_id", "lat", "lon", "hand"), "same")
    exact = settle(same.groupBy("asked").agg(first.alias("first"), F.bool_or("hand").alias("hand")), "first-of-same")
    far = _far_apart(same.join(small_side(exact.where("not hand").select("asked")), "asked", "left_semi").where("lat is not null and lon is not null").select("asked", "lat", "lon"), spread_m, "asked")
    exact = exact.join(far.withColumn("far", F.lit(True)), "asked", "left")
    exact = exact.select("asked", F.when(F.col("far").isNull(), F.col("first.place_id")).alias("place_id"), F.when(F.col("far").isNull(), "exact").otherwise("ambiguous").alias("how"))
    known_texts = small_side(settle(exact, "exact"))
    exact = asked.join(known_texts, "asked").select("wanted_id", "place_id", "how")
    left = asked.join(known_texts.select("asked"), "asked", "left_anti")
    per = settle(known.groupBy("known").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "names")
    needles = left.select(F.explode(F.array("asked", "short")).alias("needle")).distinct()
    hits = containing(needles.where("needle <> ''"), per.select("known")).join(per, "known").groupBy("needle").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    hits = small_side(settle(hits.unionByName(per.agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 0").select(F.lit("").alias("needle"), "n", "first")), "hits"))
    of = lambda c: hits.select(F.col("needle").alias(c), F.col("n").alias(f"{c}_n"), F.col("first.place_id").alias(f"{c}_id"))
    rest = left.join(of("asked"), "asked", "left").join(of("short"), "short", "left")
    only = F.coalesce(F.col("asked_n") == 1, F.lit(False))
    rest = rest.select("wanted_id", F.when(only, F.col("asked_id")).otherwise(F.col("short_id")).alias("place_id"), F.when(only, "contains").when(F.col("short_id").isNotNull(), "fuzzy").otherwise("none").alias("how"))
    return exact.unionByName(rest)


def final_keepers(gone: DataFrame) -> DataFrame:
    """place_id, keeper: gone with keepers that stay, where a row's keeper went by another rule and has a keeper itself.

    Pointers jump over the keeper of the keeper, so chains are halved each round. Rows whose keepers lead back to
    themselves have none: null. gone: place_id, keeper, each place_id once.
    """
    at = settle(gone.select("place_id", "keeper"), "keepers")
    for _ in range(max(1, at.count()).bit_length() + 1):
        on = at.select(F.col("place_id").alias("keeper"), F.col("keeper").alias("further"))
        at = settle(at.join(on, "keeper", "left").select("place_id", F.coalesce("further", "keeper").alias("keeper"), F.col("further").isNotNull().alias("open")), "keepers")
        if at.where("open").isEmpty():
            break
    return at.select("place_id", F.when(~F.col("open"), F.col("keeper")).alias("keeper"))


def collapsed(rows: DataFrame, aliases: DataFrame, pairs: DataFrame, *, shadow_m: float = 150.0, twin_m: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Rows that are left after three rules in order, and what went: place_id, keeper, rule.

    First automatic rows shadowed by a protected one of their name, then twins among what is left, then merges declared
    among what is left then (into the first of several keepers). No rule drops a protected row. A keeper may itself go by
    a later rule, or by another declared pair: see final_keepers. rows: place_id, name, category, lat, lon, owner,
    source_url, and telling fields; aliases: place_id, alias.
    """
    shadow = settle(shadowed(rows.select("place_id", "name", "lat", "lon", "owner"), aliases, metres=shadow_m).select("place_id", "keeper", F.lit("shadowed").alias("rule")), "shadowed")
    left = rows.join(shadow, "place_id", "left_anti")
    twin = settle(twins(left, metres=twin_m).select("place_id", "keeper", F.lit("twin").alias("rule")), "twins")
    left = left.join(twin, "place_id", "left_anti")
    merged = declared_merges(pairs, left).where("verdict = 'merged'")
    ids = left.groupBy("source_url").agg(F.max("place_id").alias("place_id"))
    named = merged.join(ids.withColumnsRenamed({"source_url": "drop"}), "drop").join(ids.withColumnsRenamed({"source_url": "keep", "place_id": "keeper"}), "keep")
    declared = settle(named.groupBy("place_id").agg(F.min("keeper").alias("keeper")).withColumn("rule", F.lit("declared")), "declared")
    return left.join(declared, "place_id", "left_anti"), shadow.unionByName(twin).unionByName(declared)


def curated_overlay(rows: DataFrame, curated: DataFrame, *, columns: list[str], spread_m: float = 2000.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalogue with curated rows laid over the places that their names mean; aliases to add; a verdict on each curated row.

    A place that is met takes the curated columns and is owned by hand; its vector goes if its text (name, category)
    changes; each curated name becomes an alias of its place. Of several rows that mean one place the one with the
    smallest curated_id is laid over it. Nothing is inserted: a row that means no place is unmatched, or ambiguous.
    rows: place_id, name, category, lat, lon, owner, vector, and columns; curated: curated_id, name, and columns.
    """
    found = named_in_cascade(curated.select(F.col("curated_id").alias("wanted_id"), F.col("name").alias("wanted")), rows, spread_m=spread_m)
    found = settle(found.withColumnRenamed("wanted_id", "curated_id"), "curated")
    met = curated.join(found.where("place_id is not null").select("curated_id", "place_id"), "curated_id")
    first = met.groupBy("place_id").agg(F.min_by(F.struct(*columns), "curated_id").alias("n"))
    own = settle(first.select("place_id", *(F.col("n")[c].alias(f"n_{c}") for c in columns), F.lit(True).alias("met")), "met")
    both = rows.join(small_side(own), "place_id", "left")
    value = lambda c: F.when(F.col("met"), F.col(f"n_{c}")).otherwise(F.col(c))
    text_stays = [value(c).eqNullSafe(F.col(c)) for c in ("name", "category") if c in columns]
    stays = F.lit(True) if not text_stays else text_stays[0] if len(text_stays) == 1 else text_stays[0] & text_stays[1]
    kept = [c for c in rows.columns if c not in (*columns, "owner", "vector")]
    laid = both.select(*kept, *(value(c).alias(c) for c in columns), F.when(F.col("met"), "curated").otherwise(F.col("owner")).alias("owner"), F.when(stays, F.col("vector")).alias("vector"))
    aliases = met.select("place_id", F.col("name").alias("alias")).distinct()
    how = F.when(F.col("place_id").isNotNull(), "matched").when(F.col("how") == "ambiguous", "ambiguous").otherwise("unmatched")
    return laid.select(*rows.columns), aliases, curated.select("curated_id").join(found, "curated_id", "left").select("curated_id", how.alias("verdict"))
