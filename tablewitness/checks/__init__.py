"""Registered queries over the given tables, each with the SQL that must agree where SQL can say it."""

from tablewitness.checks import corruption, learning, ordered, profile, scans, verdict  # noqa: F401
from tablewitness.checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
