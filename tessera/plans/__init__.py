"""Registered queries and the SQL that must agree with them."""

from tessera.plans import drafts, quotas, rewards, sources  # noqa: F401
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
