"""All queries of the analytics part and their SQL."""

from __future__ import annotations

from tallyscope.plans import basics, scenes  # noqa: F401  register their queries
from tallyscope.plans.scores import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
