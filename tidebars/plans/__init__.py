"""Registered queries: importing this package fills the registry."""

from tidebars.plans import analysis_queries, bar_queries, extra_queries, study_queries  # noqa: F401
from tidebars.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
