"""The registered queries: each runs an operator or job over the driver's tables, most with the
same question as SQL text for an independent engine."""

from tripflow.catalog import columns, jobs, layouts, mergeable, relational, scans, tables  # noqa: F401
from tripflow.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
