"""A whole search: signals, fusion, scope."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import retrieval, spatial


def find_places(queries: DataFrame, places: DataFrame, vectors: DataFrame, aliases: DataFrame | None = None, *, area: DataFrame | None = None, n: int = retrieval.RESULTS) -> DataFrame:
    """query_id, place_id, score, rank. Signals that a query has no input for don't vote.

    queries: query_id, and vector, category, lat, lon, words where known. area (code, rings, holes) scopes the places;
    an area without a polygon leaves them unscoped.
    """
    if area is not None and area.where("rings is not null").limit(1).count():
        held = spatial.inside(places.select("place_id", "lat", "lon"), area).select("place_id").distinct()
        places, vectors = (df.join(held, "place_id", "left_semi") for df in (places, vectors))
        aliases = aliases.join(held, "place_id", "left_semi") if aliases is not None else None
    asked = set(queries.columns)
    signals = []
    if "vector" in asked:
        signals.append(retrieval.vector_top_k(queries, vectors))
    if aliases is not None and "words" in asked:
        signals.append(retrieval.alias_signal(queries.where("words is not null"), aliases))
    if "category" in asked:
        signals.append(retrieval.category_signal(queries.where("category is not null"), places))
    if {"lat", "lon"} <= asked:
        signals.append(retrieval.nearby_signal(queries.where("lat is not null and lon is not null"), places))
    return retrieval.fuse(signals, n)
