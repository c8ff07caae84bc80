"""Validation, quarantine, guarded merges and the other steps that bring files into the catalogue.

A table is a snapshot: each function takes the old one and gives the new one, to be written beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial


def problems(*checks: tuple[Column, str]) -> Column:
    """The messages of the checks that are true; null counts as false."""
    return F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))


def row_problems() -> Column:
    """Over name, category_known, lat, lon, facts, source_url, visit_minutes as texts, as read from a file."""
    lat, lon = F.try_to_number("lat", F.lit("S999.999999")).cast("double"), F.try_to_number("lon", F.lit("S999.999999")).cast("double")
    minutes = F.expr("try_cast(visit_minutes as int)")
    return problems(
        (F.coalesce(F.trim("name"), F.lit("")) == "", "name missing"),
        (~F.coalesce("category_known", F.lit(False)), "unknown category"),
        (lat.isNull() | lon.isNull(), "coordinates not numeric"),
        (~lat.between(-90, 90) | ~lon.between(-180, 180), "coordinates out of range"),
        (F.col("facts").isNotNull() & F.try_parse_json("facts").isNull(), "facts not JSON"),
        (~F.col("source_url").startswith("src:"), "key prefix"),
        (F.col("visit_minutes").isNotNull() & minutes.isNull(), "minutes not whole"),
    )


#: The problem of a row that lies outside the project's areas.
OUTSIDE = "outside the project area"


def quarantined(rows: DataFrame, found: Column, inside: Column) -> DataFrame:
    """Adds problems and bin: valid, geofence (a point outside the project's areas, whatever else is wrong), or invalid.

    inside: whether the row's point lies in an area, see fenced(); null where there is no point, which is another problem.
    """
    out = rows.withColumn("problems", F.concat(found, F.when(~inside, F.array(F.lit(OUTSIDE))).otherwise(F.array().cast("array<string>"))))
    kind = F.when(F.size("problems") == 0, "valid").when(F.array_contains("problems", OUTSIDE), "geofence").otherwise("invalid")
    return out.withColumn("bin", kind)


def guarded_upsert(old: DataFrame, new: DataFrame, key: str, *, protected: str = "owner <> 'auto'", automatic: str = "n_owner = 'auto'") -> DataFrame:
    """key, name, category, owner, vector, change: new rows over old ones.

    The category of a protected row survives an automatic writer; a vector goes when the text it was made from
    changes. change is inserted, updated or kept.
    """
    n = new.select(key, *(F.col(c).alias(f"n_{c}") for c in ("name", "category", "owner")), F.lit(True).alias("n_here"))
    o = old.withColumn("o_here", F.lit(True))
    both = o.join(n, key, "full_outer")
    here, there = F.col("n_here").isNotNull(), F.col("o_here").isNotNull()
    guarded = here & there & F.expr(protected) & F.expr(automatic)
    name = F.when(here, F.col("n_name")).otherwise(F.col("name"))
    category = F.when(here & ~guarded, F.col("n_category")).otherwise(F.col("category"))
    owner = F.when(here & ~guarded, F.col("n_owner")).otherwise(F.col("owner"))
    same = name.eqNullSafe(F.col("name")) & category.eqNullSafe(F.col("category"))
    change = F.when(~there, "inserted").when(~here, "kept").when(same & owner.eqNullSafe(F.col("owner")), "kept").otherwise("updated")
    return both.select(key, name.alias("name"), category.alias("category"), owner.alias("owner"), F.when(there & same, F.col("vector")).alias("vector"), change.alias("change"))


def first_wins(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Rows of all frames; of those with the same keys the one of the earliest frame, then by order."""
    all_ = reduce(DataFrame.unionByName, (f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)))
    w = Window.partitionBy(*keys).orderBy("_from", *order)
    return all_.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_from")


def replace_source(old: DataFrame, new: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """All rows of a source replaced by new ones; of rows with the same keys the one of another source stays."""
    return first_wins([old.where(F.col("source") != source), new], keys, [])


def registry_write(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The file is the whole truth: its rows, and change (inserted, kept, deleted)."""
    o = old.select(key, F.lit(True).alias("o"))
    n = new.select(key, F.lit(True).alias("n"))
    change = F.when(F.col("n").isNull(), "deleted").when(F.col("o").isNull(), "inserted").otherwise("kept")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def overlay(rows: DataFrame, hints: DataFrame, key: str, column: str, *, only: Column) -> DataFrame:
    """column set from hints where the condition holds; other rows as they are."""
    h = hints.select(key, F.col(column).alias("_hint"))
    value = F.when(only & F.col("_hint").isNotNull(), F.col("_hint")).otherwise(F.col(column))
    return rows.join(h, key, "left").withColumn(column, value).drop("_hint")


def pruned(rows: DataFrame, declared: DataFrame, used: list[DataFrame], key: str) -> DataFrame:
    """Rows without the automatic ones that no file declares and nothing uses."""
    loose = rows.where("owner = 'auto'").select(key)
    for df in (declared, *used):
        loose = loose.join(df.select(key).distinct(), key, "left_anti")
    return rows.join(loose, key, "left_anti")


def coverage(rows: DataFrame, by: str) -> DataFrame:
    """by, n, filled_minutes, filled_ticket: counts and shares of filled fields; the null group is shown as a dash."""
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 4)
    return rows.groupBy(F.coalesce(by, F.lit("—")).alias(by)).agg(F.count("*").alias("n"), share(F.col("visit_minutes").isNotNull()).alias("filled_minutes"), share(F.coalesce("ticket", F.lit("")) != "").alias("filled_ticket"))


def fenced(rows: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """Adds fenced: whether a row (key, lat, lon) lies in any of the areas (rings, holes)."""
    held = spatial.inside(rows.select(key, "lat", "lon"), areas.select("rings", "holes")).select(key).distinct()
    return rows.join(held.withColumn("fenced", F.lit(True)), key, "left").withColumn("fenced", F.coalesce("fenced", F.lit(False)))
