"""All registered queries of the contact-genomics operators."""

from __future__ import annotations

from . import aggregate_queries, filter_queries, graph_queries, more_queries, source_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
