"""All registered queries of the parcel operators."""

from __future__ import annotations

from parcelspark.plans import decision, expressions, metrics, rasters, shapes, simulation, spatial  # noqa: F401
from parcelspark.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
