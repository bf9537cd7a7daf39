"""Imports every query module so that the registry is complete."""

from lapse.plans import (fact_queries, geo_queries, lifecycle_queries, report_queries,  # noqa: F401
                         cluster_queries, fuzzy_queries, ml_queries, rfm_queries, stats_queries)
from lapse.plans import compose_queries  # noqa: F401  (uses the queries above)
from lapse.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
