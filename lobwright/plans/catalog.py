"""All registered queries."""

from lobwright.plans import (  # noqa: F401
    queries_execution,
    queries_features,
    queries_models,
    queries_results,
    queries_sources,
)
from lobwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
