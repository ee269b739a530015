"""All queries of the engine's own operators."""

from __future__ import annotations

from . import relational_queries, retrieval_queries, scoring_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
