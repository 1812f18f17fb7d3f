"""All queries by name, with their SQL."""

from __future__ import annotations

from gleaner.plans import activity, catalog, desk, operations, registries, rules

QUERIES: dict = catalog.QUERIES | activity.QUERIES | operations.QUERIES | rules.QUERIES | registries.QUERIES | desk.QUERIES
SQL: dict[str, str] = catalog.SQL | activity.SQL | operations.SQL | rules.SQL | registries.SQL | desk.SQL
