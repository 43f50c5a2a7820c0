"""Registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from granary.plans import basics, modelling, preparing, splitting, testing  # noqa: F401  they register their queries
from granary.plans.registry import QUERIES, SQL  # noqa: F401
