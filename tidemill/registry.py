"""All registered queries of the feature engine and their DuckDB oracle SQL."""

from __future__ import annotations

from .oracle import oracle_sql
from .queries import queries

__all__ = ["oracle_sql", "queries"]
