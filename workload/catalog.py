"""All registered queries."""

from workload import edit_queries, ingest_queries, report_queries, scalar_queries  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
