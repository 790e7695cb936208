"""Registered queries with their SQL, over stand-in views of the driver's tables."""

from . import core_queries, source_queries, text_queries  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
