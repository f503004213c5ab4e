"""All registered queries."""

from tierflow.plans import learning, rows, streams, traces  # noqa: F401
from tierflow.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
