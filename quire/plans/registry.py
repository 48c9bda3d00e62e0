"""Queries by name, and the SQL that gives the same rows."""

from quire.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
