"""All queries on the fleet side of the library, by name, with the SQL that must agree."""

from __future__ import annotations

from . import audits, boosted, dynamics, evaluation, events, panels, protocol, rules, sensors, stateful  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
