"""All registered queries and the DuckDB statements that give the same rows."""

from __future__ import annotations

from quire.plans import aggregates, booklets, browsing, clusters, graphs, joins, papers, parsing, site  # noqa: F401  registration
from quire.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
