"""Map elements into a place file, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import spatial
from ..sources import elements, files


def seeded(scanned: DataFrame, excluded: DataFrame, districts: DataFrame, towns: DataFrame, path: str, *, town_m: float = 5000.0) -> DataFrame:
    """Elements converted to sights, without excluded names, with their district and the nearest town; written to path and read back.

    excluded: name. districts: code, rings, holes; of several that hold a sight the first by code is its own. towns:
    town, lat, lon; the nearest within town_m.
    """
    names = excluded.select(text.matched_name(F.col("name")).alias("norm")).distinct()
    rows = elements.sights(scanned).withColumn("norm", text.matched_name(F.col("name"))).join(names, "norm", "left_anti")
    held = spatial.inside(rows.select("source_url", "lat", "lon"), districts.select("code", "rings", "holes")).groupBy("source_url").agg(F.min("code").alias("district"))
    centres = towns.select("town", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = spatial.nearest_k(rows.select("source_url", "lat", "lon"), centres, 1, town_m, key=["source_url"], order=[F.col("town")]).select("source_url", "town")
    out = rows.join(held, "source_url", "left").join(near, "source_url", "left")
    own = {"name", "category", "district", "town", "source_url"}
    said = {"lat": F.format_string("%.6f", "lat"), "lon": F.format_string("%.6f", "lon"), "fun_facts": F.lit("[]"), "links": F.lit("[]")}
    files.write_places(out.select(*(F.col(c) if c in own else said.get(c, F.lit(None).cast("string")).alias(c) for c in files.PLACE_COLUMNS)), path)
    return files.read_places(rows.sparkSession, path)
