"""The registered queries and their SQL."""

from .plans import queries_catalog, queries_community, queries_ingest, queries_library  # noqa: F401
from .plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
