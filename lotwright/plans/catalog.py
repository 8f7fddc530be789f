"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from lotwright.plans import analysis, captures, exports, identity, landed, listings, lots, matching, money, proofs, recapture, records, rest, retail, routes, state, text, urls  # noqa: F401  each registers its queries

from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
