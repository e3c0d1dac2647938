"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import analytics, knowledge, records, scalars

QUERIES, ORACLES = analytics.QUERIES, analytics.ORACLES

__all__ = ["ORACLES", "QUERIES", "analytics", "knowledge", "records", "scalars"]
