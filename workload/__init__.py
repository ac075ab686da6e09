"""The registered queries: library operators on the test tables, next to plain SQL."""

from workload.registry import QUERIES, Query

# Importing a module registers its queries.
from workload import (  # noqa: F401, E402
    aggregates,
    domains,
    files,
    joins,
    projections,
    quality,
    sinks,
    streams,
)

__all__ = ["QUERIES", "Query"]
