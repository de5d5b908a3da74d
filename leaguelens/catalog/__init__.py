"""The registered queries."""

from leaguelens.catalog import analytics, basics, reporting  # noqa: F401
from leaguelens.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
