"""All registered queries."""

from mailrisk.plans import cohort_queries, job_queries, run_queries, source_queries, text_queries  # noqa: F401
from mailrisk.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
