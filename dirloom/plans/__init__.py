"""Registered queries."""

from . import fetching, generated  # noqa: F401  they register their queries
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
