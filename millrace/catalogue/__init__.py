"""Registered queries: each with its DuckDB SQL, where SQL can express it."""

from __future__ import annotations

from .registry import QUERIES, Query
from . import aggregates, control, joins, layouts, scalars, upserts, windows  # noqa: F401  each registers its queries

__all__ = ["QUERIES", "Query"]
