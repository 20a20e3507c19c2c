"""Registered queries: each reads the given tables, and most carry the equivalent SQL for checking."""

from __future__ import annotations

from seriesloom.plans.catalog import models, panel, relational, scoring  # noqa: F401  (registration)
from seriesloom.plans.catalog.base import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
