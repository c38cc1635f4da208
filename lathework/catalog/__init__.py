"""All registered queries of the core."""

from lathework.catalog import analytics, diffs, feedback, general, impact, retrieval, scans, sources, streams  # noqa: F401
from lathework.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
