"""All registered queries."""

from vaultframe.plans import content_queries, report_queries, retention_queries
from vaultframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "content_queries", "report_queries", "retention_queries"]
