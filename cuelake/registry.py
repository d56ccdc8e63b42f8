"""Every query of the engine's own operators by name, and its DuckDB equivalent."""

from __future__ import annotations

from .plans import queries as plans


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.ORACLES)
