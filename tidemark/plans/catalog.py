"""All registered queries."""

from tidemark.plans import market, reference, streams  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
