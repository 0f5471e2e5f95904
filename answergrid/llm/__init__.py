"""Operators that prepare training text. Nothing else in the library imports them."""

from answergrid.llm import mining_queries, queries  # noqa: F401
from answergrid.llm.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
