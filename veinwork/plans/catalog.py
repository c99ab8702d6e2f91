"""All queries of the library and their SQL."""

from __future__ import annotations

from veinwork.plans import fast, records, retrieval, rules, texts  # noqa: F401  they register their queries
from veinwork.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
