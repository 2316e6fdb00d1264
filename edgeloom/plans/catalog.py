"""The registered queries and their SQL."""

from __future__ import annotations

from . import graph_queries, history_queries, ranking_queries, source_queries, stream_queries
from .registry import ORACLES, QUERIES

__all__ = ["graph_queries", "history_queries", "oracle_sql", "queries", "ranking_queries", "source_queries", "stream_queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
