"""All registered queries and the DuckDB SQL they are checked against."""

from __future__ import annotations

from millrace.plans import deliveries, live, lookups, more, producers, selection  # noqa: F401  they register their queries
from millrace.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
