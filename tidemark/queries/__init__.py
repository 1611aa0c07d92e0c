"""All queries over the driver's tables."""

from tidemark.queries import join_queries, metric_queries, model_queries, panel_queries, prep_queries, publish_queries, quality_queries, scan_queries, serving_queries  # noqa: F401
from tidemark.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
