"""All registered queries."""

from pulsegrid.plans.registry import ORACLES, QUERIES
from pulsegrid.plans import (model_queries, relational_queries, scalar_queries, series_queries,  # noqa: F401
                             source_queries, stream_queries)

__all__ = ["ORACLES", "QUERIES"]
