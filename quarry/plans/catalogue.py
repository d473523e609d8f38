"""All registered queries of the engine and their DuckDB oracles."""

from __future__ import annotations

from quarry.plans import court_queries, coverage_queries, io_queries, join_queries, report_queries, text_queries, window_queries  # noqa: F401  they register
from quarry.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(sorted(ORACLES.items()))
