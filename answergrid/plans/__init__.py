"""Queries over the test tables, with their meaning in plain SQL."""

from answergrid.plans import (  # noqa: F401
    export_queries,
    field_queries,
    history_queries,
    shape_queries,
)
from answergrid.plans.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
