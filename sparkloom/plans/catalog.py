"""Every query of the engine over the standard tables, with the SQL it equals where SQL can say it."""

from __future__ import annotations

from sparkloom.plans import knowledge, relational, retrieval, sources  # noqa: F401  (they register their queries)
from sparkloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
