"""The queries over the reference operators, and the SQL that states the same."""

from __future__ import annotations

from tabweave.plans import aligning, cleaning, measuring, reading, shaping, uniting  # noqa: F401 - they register their queries
from tabweave.plans.registry import ORACLE, QUERIES  # noqa: F401
