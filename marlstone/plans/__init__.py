"""Registered queries: ``QUERIES`` by name, and ``ORACLES``, the SQL that gives the same rows."""

from marlstone.plans import graphs, market, postings, series, texts  # noqa: F401  they register their queries
from marlstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
