"""Named queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import code, lines, metrics, pointers, program, quality, samples, vocab  # noqa: F401  (each registers its queries)
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
