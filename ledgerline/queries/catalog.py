"""All registered queries."""

from __future__ import annotations

from ledgerline.queries import cleaning, joining, modelling, profiling, sources, windowing  # noqa: F401
from ledgerline.queries.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
