"""All registered queries of the relational part, and their SQL."""

from __future__ import annotations

from . import books, changes, checks, lists, scalars, stores, streams, whole  # noqa: F401  (they register their queries)
from .registry import ORACLE, QUERIES, Query, query, table

__all__ = ["ORACLE", "QUERIES", "Query", "query", "table"]
