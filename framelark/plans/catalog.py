"""All queries of the analytics library, with their SQL."""
from __future__ import annotations

from . import filtering, spatial, temporal

PARTS = (filtering, temporal, spatial)


def queries() -> dict:
    return {k: v for p in PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for p in PARTS for k, v in p.ORACLE.items()}
