"""Predicates that depend on what was asked."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_column_contains(needles: dict[str, str]) -> Column:
    """Any column contains its needle, case aside; empty needles are switched off, and all of them off keeps every row."""
    on = [F.contains(F.lower(c), F.lit(n.lower())) for c, n in needles.items() if n]
    return reduce(or_, on) if on else F.lit(True)


def given(**wanted: Column | str) -> Column:
    """Column equals value for every value that is given; an empty text switches its filter off."""
    on = [F.col(c) == v for c, v in wanted.items() if not (isinstance(v, str) and v == "")]
    return reduce(and_, on) if on else F.lit(True)


def with_role(places: DataFrame, categories: DataFrame, *, pinned: Column) -> DataFrame:
    """Adds role by category; pinned places are sights."""
    role = categories.select(F.col("code").alias("category"), "role")
    return places.join(role, "category").withColumn("pinned", pinned).withColumn("role", F.when(F.col("pinned"), "sight").otherwise(F.col("role")))


def clamped(value: Column, low: float, high: float) -> Column:
    """struct(held, clamped)."""
    held = F.least(F.lit(high), F.greatest(F.lit(low), value))
    return F.struct(held.alias("held"), (held != value).alias("clamped"))


def reachable(seconds: Column, *, unknown_counts: bool) -> Column:
    """Whether a leg can be walked; a leg not measured (NaN) counts or not, as the caller says; 1e9 is unreachable."""
    return F.when(F.isnan(seconds), F.lit(unknown_counts)).otherwise(seconds < 1e9)


def sound_line(points: Column, most: int = 2000) -> Column:
    """At least two points, not too many, all finite."""
    fine = F.forall(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull() & ~F.isnan(p["lat"]) & ~F.isnan(p["lon"]))
    return F.coalesce((F.size(points) >= 2) & (F.size(points) <= most) & fine, F.lit(False))
