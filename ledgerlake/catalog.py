"""All queries over the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import company, exchange, extraction, growth, panel, reports, retrieval, tools

_PLANS = (panel, retrieval, extraction, company, tools, reports, exchange, growth)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
