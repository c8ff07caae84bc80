"""Queries by operator, and the SQL that gives the same rows."""

from . import catalogue, etl, geometry, measures, requirements, retrieval, spatial, store, streams, tables, texts, tours  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

ENTRY = "find_places"

__all__ = ["ENTRY", "ORACLE_SQL", "QUERIES"]
